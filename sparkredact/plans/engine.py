"""The engine: segments through the stages to a lookup and redacted segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import columns, detect, lookup, models, replay, segments, similarity
from ..lineage import cut
from ..options import Options
from ..schema import DETECTIONS
from ..sources import files

#: What hides a term from later stages: a bracket, which no stage reads into.
HIDDEN = "[X]"


@dataclass
class Result:
    redacted: DataFrame
    lookup: DataFrame
    detections: DataFrame
    flagged: DataFrame


class Engine:
    """Pseudonymises segments. Stages see the text without what earlier stages found; tags are given once, at the end.

    Segments are shuffled twice, before the stages and for the result; between stages only terms are (a row for each
    distinct term of a document).
    """

    def __init__(self, spark: SparkSession, options: Options = Options(), ner: models.Provider | None = None, encoder: models.Provider | None = None, tagger: models.Provider | None = None, vectors: DataFrame | None = None):
        """vectors (word in lower case, vector) serve the aliases by likeness of meaning, which go with fuzzy matching."""
        self.spark, self.options, self.ner, self.encoder, self.tagger, self.vectors = spark, options, ner, encoder, tagger, vectors

    def stages(self):
        """Name and function of each stage in order; options.layers, if any, names those that run."""
        o = self.options
        known = [
            ("email", detect.emails, True),
            ("org", detect.organisations, True),
            ("titled", detect.titled_names, True),
            ("column", lambda s: columns.mapped_columns(s, o.column_mapping), o.column_mapping),
            ("structured", detect.structured, True),
            ("entropy", lambda s: detect.secrets(s, o.min_entropy, o.min_length), True),
            ("ner", lambda s: models.ner(s, self.ner), self.ner),
            ("syntactic", lambda s: models.proper_nouns(s, self.tagger), self.tagger),
            ("names", detect.dictionary_names, True),
            ("custom", lambda s: detect.custom_words(s, list(o.custom_lists)), o.custom_lists),
        ]
        return [(name, stage) for name, stage, on in known if on and self._runs(name)]

    def _runs(self, name: str) -> bool:
        return not self.options.layers or name in self.options.layers

    def detect(self, rows: DataFrame) -> DataFrame:
        """All stages' detections. They are small and checkpointed; every stage's view comes from the segments and what was found so far.

        Segments are dealt by document once and kept on disk like that while stages run, so that only terms move to them.
        """
        rows = rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").persist(StorageLevel.DISK_ONLY)
        try:
            return self._detect(rows)
        finally:
            rows.unpersist()

    def _detect(self, rows: DataFrame) -> DataFrame:
        view, found, names, o = rows, [self._nothing()], None, self.options
        width = (rows.agg(F.max(F.size("cells"))).first()[0] or 0) if o.column_mapping else 0
        for name, stage in self.stages():
            found.append(cut(stage(view)))
            terms = detect.union(found).select(F.col("doc_id").alias("scope"), F.col("original").alias("form"), F.lit(HIDDEN).alias("tag")).distinct()
            view = replay.redact_segments(rows, terms)
            if width and name == "column":
                names = lookup.assign_tags(detect.union(found), o.lookup_mode)
            if names is not None:  # names known by then are masked in the columns that aren't mapped too
                view = columns.cross_reference(view, names, o.column_mapping, width, o.lookup_mode)
        return detect.union(found)

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], DETECTIONS)

    def anonymize(self, rows: DataFrame) -> Result:
        """Redacted segments, lookup, all detections and the lines on which the encoder failed."""
        o = self.options
        found = self.detect(rows)
        flagged = rows.select("doc_id", "line_number").limit(0)
        if self.encoder and self._runs("encoder"):
            terms, flagged = models.encoder(segments.split_long_lines(rows, o.max_line_chars), self.encoder, list(o.enabled_categories) or None)
            found = found.unionByName(terms)
        if o.fuzzy_matching:
            found = found.unionByName(self._fuzzy(rows, lookup.assign_tags(found, o.lookup_mode)))
            if self.vectors is not None:
                found = found.unionByName(self._alike(rows, lookup.assign_tags(found, o.lookup_mode)))
        table = lookup.assign_tags(found, o.lookup_mode)
        table, _ = lookup.filter_categories(table, o.enabled_categories)
        table, _ = lookup.validate(table)
        if o.replay == "all_forms":
            forms = lookup.forms(found, table, o.lookup_mode)
        else:
            forms = table.select("scope", F.col("original_term").alias("form"), F.col("anonymised_term").alias("tag"))
        return Result(replay.redact_segments(rows, forms, o.lookup_mode), table, found, flagged)

    def _fuzzy(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        tokens = detect.title_case_tokens(rows)
        common = self.spark.createDataFrame([(w,) for w in V.COMMON_WORDS], "part string")
        return self._aliases(tokens, similarity.fuzzy_aliases(tokens.select("word"), table, common), table, "fuzzy")

    def _alike(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        tokens = detect.title_case_tokens(rows)
        common = self.spark.createDataFrame([(w,) for w in V.COMMON_WORDS], "part string")
        return self._aliases(tokens, similarity.vector_aliases(tokens.select("word"), table, common, self.vectors), table, "embedding")

    def _aliases(self, tokens: DataFrame, close: DataFrame, table: DataFrame, layer: str) -> DataFrame:
        owner = table.select(F.explode(F.split(F.lower("original_term"), r"(?U)\s+")).alias("target"), F.col("original_term").alias("owner")).groupBy("target").agg(F.min("owner").alias("owner"))
        hits = tokens.join(close.join(owner, "target"), "word")
        return detect.detections(hits, layer, [F.col("pos")], F.col("word"), F.col("category"), F.col("owner"))

    def anonymize_files(self, path: str, out: str) -> Result:
        """Read, redact and write all files under a path, with the lookup beside them."""
        result = self.anonymize(files.read_files(self.spark, path))
        files.write_files(result.redacted, out, self.options.output_format)
        files.write_lookup(result.lookup, f"{out}/lookup")
        return result

    def anonymize_texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Result:
        return self.anonymize(segments.segments_of_texts(docs, id_col, text_col))
