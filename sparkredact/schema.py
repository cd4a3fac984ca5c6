"""Schemas of the tables that stages hand on."""

CELL = "struct<text:string,sheet_name:string,row_index:int,col_index:int>"
SEGMENTS = f"doc_id string, source_file string, source_format string, line_number int, is_subline boolean, sub_index int, cells array<{CELL}>"
#: ord: where a term was registered inside its stage, compared item by item.
DETECTIONS = "doc_id string, stage int, line_number int, ord array<int>, original string, category string, alias_of string, layer string"
LOOKUP = "scope string, norm_key string, original_term string, anonymised_term string, pii_category string, first_seen_doc string, first_seen_line int, is_alias boolean, seq long"
