"""Values that have to be exactly these for results to be right.

Everything here is a fixed value: accepted words, tag names, text patterns,
default ports and schemas, endpoint fields and message formats.  No logic.
"""

# --- fixed values: cast tags of the strict dialect --------------------------
STRICT_TAGS = ("STRING", "NUMBER", "BOOLEAN", "DATE")

# --- fixed values: words accepted by the BOOLEAN cast -----------------------
TRUE_WORDS = ("true", "t", "1", "yes", "y")
FALSE_WORDS = ("false", "f", "0", "no", "n")

# --- fixed values: tag fragments of the lenient dialect, in match order -----
LENIENT_FRAGMENTS = (
    ("INT", "int"),
    ("DECIMAL", "number"),
    ("FLOAT", "number"),
    ("DOUBLE", "number"),
    ("BOOL", "bool"),
    ("DATE", "date"),
    ("TIME", "date"),
)

# --- fixed values: white space and number grammar of ECMAScript text --------
JS_WHITESPACE = (
    "\t\n\u000b\u000c\r\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
JS_DECIMAL = r"^[+-]?(Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)$"
JS_MAX_DATE_MILLIS = 8.64e15

# --- fixed values: type labels inferred from text cells ---------------------
INT_TEXT = r"^-?\d+\z"
FLOAT_TEXT = r"^-?\d+(\.\d+)?\z"
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}"

# --- fixed values: names whose content is masked, and the mask --------------
SECRET_NAME = r"(?i)(password|secret|key)"
MASK = "****"

# --- fixed values: endpoint types, default ports and schemas ----------------
ENDPOINT_ALIASES = {
    "csv": "csv",
    "excel": "excel",
    "postgres": "postgres",
    "postgresql": "postgres",
    "mysql": "mysql",
    "mssql": "mssql",
    "sqlserver": "mssql",
    "oracle": "oracle",
    "s3": "s3",
    "gcs": "gcs",
    "azureblob": "azureBlob",
}
DEFAULT_PORT = {"postgres": 5432, "mysql": 3306, "mssql": 1433, "oracle": 1521}
DEFAULT_SCHEMA = {"postgres": "public", "mssql": "dbo"}

# --- fixed values: config fields asked for per endpoint type ----------------
ENDPOINT_FIELDS = {
    "csv": ("path",),
    "excel": ("path", "sheet"),
    "postgres": ("host", "port", "user", "password", "database", "schema", "table"),
    "oracle": ("host", "port", "service", "user", "password", "schema", "table"),
    "mysql": ("host", "port", "user", "password", "database", "table"),
    "mssql": ("host", "port", "user", "password", "database", "schema", "table"),
    "s3": ("region", "bucket", "key", "accessKeyId", "secretAccessKey"),
    "gcs": ("projectId", "bucket", "key", "keyFilename"),
    "azureBlob": ("connectionString", "accountName", "accountKey", "container", "blob"),
}

# --- fixed values: fields of the list above that have a default -------------
OPTIONAL_FIELDS = {
    "csv": (),
    "excel": ("sheet",),
    "postgres": ("port", "schema"),
    "oracle": ("port", "schema"),
    "mysql": ("port",),
    "mssql": ("port", "schema"),
    "s3": ("accessKeyId", "secretAccessKey"),
    "gcs": ("projectId", "keyFilename"),
    "azureBlob": ("connectionString", "accountName", "accountKey"),
}

# --- fixed values: message formats ------------------------------------------
RUN_COMPLETE = "Run complete: {rows} rows moved {source} → {destination}"
MISSING_ENDPOINT = "Missing source/destination"
UNSUPPORTED_SOURCE = "Unsupported source type: {}"
UNSUPPORTED_DESTINATION = "Unsupported destination type: {}"
UNSUPPORTED_TYPE = "Unsupported type: {}"
ISSUE_NO_TYPE = "pick a database"
ISSUE_EMPTY_FIELD = "'{}' is empty"
ISSUE_NO_INBOUND = "no incoming connection"
