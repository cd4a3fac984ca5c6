"""Word lists, label maps and patterns that results depend on, in one place.

They state what is recognised, not how. Patterns are Java regular expressions.
"""

from __future__ import annotations

CATEGORIES = ["NAME", "ORG", "LOCATION", "JOBTITLE", "EMAIL", "PHONE", "ID", "DOB", "POSTCODE", "IP", "URL"]
#: What a column may be mapped to besides a category.
NOT_TAGGED = ["skip", "freetext"]

# ---- fixed values: words -------------------------------------------------------------------------------------

ADDRESS_WORDS = (
    "street st road rd lane ln drive dr boulevard blvd court ct place pl way circle crescent terrace close green gardens "
    "park square row mews walk hill hollow haven glen amble colonnade cliffs inlet gates heights shores crest ridge crossing "
    "junction pass path bend apt suite circles hills formation locks knoll knolls flats pines manor meadow meadows vista run "
    "fork forks trace trail turnpike bypass overpass underpass burg burgh avenue ave rue via calle north south east west lake "
    "port mount saint fort cape salai marg nagar chowk"
).split()
PLACE_SUFFIXES = "burg burgh borough ville stad town field ford bridge chester shire mouth port land view side dale wood ston".split()
STOP_WORDS = "the and for but with or a an to in on at of is was are be as it by not no so if do up my we he me".split()
ROLE_WORDS = (
    "applicant borrower consignor consignee claimant complainant defendant plaintiff respondent petitioner inspector examiner "
    "auditor investigator assessor omitted redacted withheld confidential restricted"
).split()
PLACEHOLDERS = [
    "n/a", "na", "n.a.", "unknown", "tbd", "none", "null", "not applicable", "not available", "to be filled in", "to be determined", "to be confirmed", "pending",
]
NUMERIC_CATEGORIES = ["ID", "PHONE", "DOB", "POSTCODE"]
#: Words of titles, organisations, addresses, countries, business and the calendar that never count as names.
NEVER_NAMES = (
    "professor doctor councillor minister director sheikh imam mullah reverend bishop cardinal deacon sergeant lieutenant "
    "captain colonel general commander ambassador president chancellor chairman inspector superintendent officer governor "
    "senator commissioner warden dean provost rector pastor vicar ltd inc corp gmbh plc llc institut institute university "
    "college academy foundation council department ministry bureau authority commission hospital clinic surgery pharmacy "
    "street road lane drive boulevard court place avenue terrace crescent close mews walk hill square row gardens park green "
    "circle way rue via calle salai marg nagar chowk corniche prospekt ridge path trail crossing hollow haven glen inlet "
    "heights manor meadow vista clinical completed certified applied advanced senior junior principal associate assistant "
    "digital technical financial international national engineering consulting analytics services solutions research telecom "
    "england scotland wales tunisie algerie maroc deutschland schweiz january february march april may june july august "
    "september october november december monday tuesday wednesday thursday friday saturday sunday jan feb mar apr jun jul aug "
    "sep oct nov dec"
).split()
SYNTACTIC_ROLES = ["dobj", "pobj", "iobj", "attr", "appos", "nsubj", "nsubjpass", "conj"]

# ---- fixed values: labels ------------------------------------------------------------------------------------

ENCODER_LABELS = {
    "GIVENNAME": "NAME", "SURNAME": "NAME", "MIDDLENAME": "NAME", "USERNAME": "NAME", "TITLE": "JOBTITLE", "EMAIL": "EMAIL",
    "TELEPHONENUM": "PHONE", "DATEOFBIRTH": "DOB", "DATE": "DOB", "TIME": "DOB", "CITY": "LOCATION", "STREET": "LOCATION",
    "BUILDINGNUM": "LOCATION", "COUNTRY": "LOCATION", "STATE": "LOCATION", "ZIPCODE": "POSTCODE", "SOCIALNUM": "ID",
    "IDCARDNUM": "ID", "ACCOUNTNUM": "ID", "CREDITCARDNUMBER": "ID", "DRIVERLICENSENUM": "ID", "TAXNUM": "ID", "PASSWORD": "ID",
    "PER": "NAME", "PERSON": "NAME", "ORG": "ORG", "ORGANIZATION": "ORG", "LOC": "LOCATION", "LOCATION": "LOCATION",
    "GPE": "LOCATION", "ADDRESS": "LOCATION", "PHONE": "PHONE", "PHONENUMBER": "PHONE", "URL": "URL", "IP": "IP",
    "IPADDRESS": "IP", "DOB": "DOB",
}
NER_TYPES = {
    "PERSON": "NAME", "LOCATION": "LOCATION", "ORG": "ORG", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE",
    "IP_ADDRESS": "IP", "URL": "URL", "DATE_TIME": "DOB", "US_SSN": "ID", "UK_NINO": "ID", "CREDIT_CARD": "ID", "IBAN_CODE": "ID",
}
#: Which type wins where two cover one span (lower first; 99 for any other), and the types with a lower threshold.
NER_PRIORITY = {
    "PERSON": 0, "EMAIL_ADDRESS": 1, "PHONE_NUMBER": 1, "US_SSN": 1, "UK_NINO": 1, "IP_ADDRESS": 2, "URL": 2,
    "CREDIT_CARD": 2, "IBAN_CODE": 2, "DATE_TIME": 3, "LOCATION": 4, "ORG": 5,
}
NER_LENIENT, NER_THRESHOLD, NER_LENIENT_THRESHOLD = ["PHONE_NUMBER", "US_SSN", "UK_NINO"], 0.5, 0.3
HEADER_SUGGESTIONS = {
    "first name": "NAME", "firstname": "NAME", "last name": "NAME", "lastname": "NAME", "surname": "NAME", "name": "NAME",
    "full name": "NAME", "manager": "NAME", "contact": "NAME", "contact name": "NAME",
    "email": "EMAIL", "e-mail": "EMAIL", "email address": "EMAIL", "manager email": "EMAIL",
    "phone": "PHONE", "telephone": "PHONE", "tel": "PHONE", "mobile": "PHONE", "cell": "PHONE", "fax": "PHONE",
    "address": "LOCATION", "street": "LOCATION", "street address": "LOCATION", "city": "LOCATION", "town": "LOCATION",
    "country": "LOCATION", "region": "LOCATION", "county": "LOCATION", "state": "LOCATION",
    "postcode": "POSTCODE", "zip": "POSTCODE", "zip code": "POSTCODE", "postal code": "POSTCODE",
    "company": "ORG", "organisation": "ORG", "organization": "ORG", "employer": "ORG", "firm": "ORG",
    "job title": "JOBTITLE", "role": "JOBTITLE", "position": "JOBTITLE", "title": "JOBTITLE", "occupation": "JOBTITLE",
    "dob": "DOB", "date of birth": "DOB", "birthday": "DOB", "birth date": "DOB", "birthdate": "DOB",
    "notes": "Freetext", "comments": "Freetext", "description": "Freetext", "bio": "Freetext", "remarks": "Freetext",
    "id": "Skip", "#": "Skip", "row": "Skip", "index": "Skip",
}
#: Types of gold entities in evaluation data.
GOLD_TYPES = {
    **dict.fromkeys(["name", "first_name", "last_name", "user_name"], "NAME"), "email": "EMAIL", "phone_number": "PHONE",
    **dict.fromkeys([
        "ssn", "account_number", "credit_card_number", "employee_id", "customer_id", "unique_identifier", "medical_record_number",
        "health_plan_beneficiary_number", "certificate_license_number", "national_id", "tax_id", "license_plate", "vehicle_identifier",
        "device_identifier", "biometric_identifier", "api_key", "password", "swift_bic", "bank_routing_number", "cvv", "pin", "account_id",
    ], "ID"),
    **dict.fromkeys(["address", "street_address", "city", "state", "country", "coordinate"], "LOCATION"),
    **dict.fromkeys(["zip_code", "postcode"], "POSTCODE"), "company_name": "ORG", "job_title": "JOBTITLE", "job_area": "JOBTITLE",
    **dict.fromkeys(["date_of_birth", "date", "date_time", "time"], "DOB"), "ipv4": "IP", "ipv6": "IP", "url": "URL",
}
ESSAY_LABELS = {"NAME": "NAME_STUDENT", "EMAIL": "EMAIL", "PHONE": "PHONE_NUM", "ID": "ID_NUM", "URL": "URL_PERSONAL", "LOCATION": "STREET_ADDRESS"}

# ---- fixed values: patterns ----------------------------------------------------------------------------------

EMAIL = r"(?U)\b[\w.-]+@[\w.-]+\.\w{2,}\b"
ORG_SUFFIXES = (
    "PLC|Ltd|Limited|Inc|Incorporated|Corp|Corporation|LLC|LLP|GmbH|AG|SA|NV|BV|SE|SRL|Pty|Co\\.?|Group|Holdings|Partners|Associates|"
    "Enterprises|& Co\\.?|University|Institute|Hospital|Council|Foundation|Academy|Centre|Center|Clinic|College|School|Trust|Authority|"
    "Bureau|Commission|Agency|Ministry|Department"
)
#: What a line with an organisation holds; it is looked for first, since the whole pattern tries every run of capitalised words many ways.
ORG_END = rf"(?U)(?:{ORG_SUFFIXES})\b"
ORG = rf"(?U)\b(?:[A-Z][a-zA-Z]*[-']?[a-zA-Z]*[\s-]?){{1,5}}(?:{ORG_SUFFIXES})\b"
TITLES = (
    "Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Rev|Reverend|Sgt|Sergeant|Lt|Lieutenant|Cpl|Corporal|Capt|Captain|Col|Colonel|Gen|General|Cmdr|"
    "Commander|Adm|Admiral|Supt|Superintendent|Insp|Inspector|Det|Detective|Hon|Honourable|Honorable|Sen|Senator|Rep|Representative|Gov|"
    "Governor|Amb|Ambassador|Cllr|Councillor|Fr|Father|Sr|Sister|Br|Brother|Dame|Lord|Lady|Sir"
)
TITLED_NAME = rf"(?U)\b(?:{TITLES})\.?\s+((?:(?:[A-Z][a-z]*(?:['’-][A-Z][a-z]+)+|[A-Z][a-z]+)\s*){{1,3}})"
TITLE_CASE = r"(?U)\b[A-Z][a-z]+(?:-[A-Z][a-z]+)*\b"
SECRET = r"(?U)\b[A-Za-z0-9_-]{8,}\b"

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
#: (category, pattern, group, check) in the order in which they claim text; check: a function in ``text``.
STRUCTURED = [
    ("URL", r"(?iU)https?://[^\s<>\"')\]]+", 0, None),
    ("URL", r"(?iU)ftp://[^\s<>\"')\]]+", 0, None),
    ("URL", r"(?iU)\bwww\.[\w.-]+\.\w{2,}(?:/[^\s<>\"')\]]*)?", 0, None),
    ("IP", rf"(?U)\b(?:{_OCTET}\.){{3}}{_OCTET}\b", 0, None),
    (
        "PHONE",
        r"(?U)(?:\+\d{1,3}[\s.-]?\(?\d{1,5}\)?(?:[\s.-]?\d{1,5}){1,4}|\(\d{3}\)[\s.-]?\d{3}[\s.-]?\d{4}|\b\d{3}-\d{3}-\d{4}\b|\b0\d{2,4}[\s.-]\d{3,4}[\s.-]?\d{3,4}\b)",
        0,
        "plausible_phone",
    ),
    ("ID", r"(?iU)\b[A-CEGHJ-PR-TW-Z][A-EGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", 0, "luhn_if_digits"),
    ("ID", r"(?U)\b\d{3}-\d{2}-\d{4}\b", 0, "luhn_if_digits"),
    ("ID", r"(?U)\b\d{4}[\s-]\d{4}[\s-]\d{4}[\s-]\d{4}\b", 0, "luhn_if_digits"),
    ("ID", r"(?U)\b\d{13,19}\b", 0, "luhn_if_digits"),
    ("POSTCODE", r"(?iU)\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b", 0, None),
    ("POSTCODE", r"(?iU)\b[A-Z]\d[\dW]\s?[A-Z\d]{4}\b", 0, None),
    ("POSTCODE", r"(?U)\b\d{5}-\d{4}\b", 0, None),
    ("POSTCODE", r"(?U)(?<=\b[A-Z]{2}\s)\d{5}\b", 0, None),
    ("ID", r"(?iU)(?:passport|travel\s+document)\s*(?:no\.?|number|num|#)?[\s:]*([A-Z]\d{7})\b", 1, "luhn_if_digits"),
    ("DOB", r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", 0, "plausible_date"),
]

# ---- this library's own small dictionaries; larger ones are read from files ----------------------------------------

FIRST_NAMES = "jane john mary james anna peter fatima grace omar lucia rose will mark priya chen aisha tomas ingrid yusuf elena".split()
LAST_NAMES = "smith jones okafor hassan garcia murphy connor müller rossi novak park kim singh andersson dubois tanaka silva".split()
COMMON_WORDS = "the and rose will mark park grace may hope joy in on at is are was one for with from this that you king complete consult".split()
