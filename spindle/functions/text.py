"""Scalar functions as column expressions: names, connection strings, untrusted text, SQL detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of column names that tell personal or secret data.
SENSITIVE = (
    "email", "e_mail", "mail", "phone", "mobile", "tel", "ssn", "sin", "nin", "aadhaar", "aadhar", "pan", "passport", "licen[cs]e", "dob", "birth",
    "first_?name", "last_?name", "full_?name", "surname", "name", "address", "street", "zip", "postcode", "postal", "iban", "bic", "swift", "account_?no",
    "account_?number", "card", "cvv", "pin", "password", "passwd", "pwd", "secret", "token", "api_?key", "auth", "credential", "salary", "income",
    "ip", "ip_?address", "lat", "latitude", "lng", "long", "longitude", "geo", "device_?id", "imei", "mac", "biometric", "health", "diagnosis", "religion", "ethnic",
)
# Things whose name, address and so on is not personal.
NON_PERSONAL = (
    "product", "item", "sku", "brand", "company", "org", "organisation", "organization", "team",
    "department", "project", "service", "table", "column", "field", "file", "folder", "database",
    "schema", "index", "tag", "category", "event", "job", "task", "step", "model", "report",
    "dashboard", "metric", "currency", "country", "region", "city", "state", "store", "warehouse",
    "vendor", "supplier", "channel", "campaign", "role", "group", "status", "type", "class", "node",
)
SENSITIVE_PATTERN = "(^|_)(" + "|".join(SENSITIVE) + ")(_|$)"
KEY_PATTERN, DEVICE_PATTERN = "(_id|_key|_sk|_fk)$", "^(device|account|card)"
SAFE_PATTERN = "^(" + "|".join(NON_PERSONAL) + ")(_name|_mail|_address|_ip|_lat|_long)$"
# Names whose assigned values are never shown.
SECRET_ASSIGNED = r"(?i)(password|passwd|pwd|token|secret|api_key|private_key)=([^;&\s]+)"
TEMPORAL_NAME = "date|time|timestamp|_at|_ts|day"
SQL_KEYWORD = r"(?i)\b(select|insert|update|delete|merge|create|with)\b"
SQL_SHAPE = r"(?i)\b(from|into|join|update|table)\s+[A-Za-z_{\"`\[]"
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\u200B-\\u200F\\u2028\\u2029\\u202A-\\u202E\\uFEFF]"


def is_sensitive(name: Column) -> Column:
    n = F.lower(name)
    key = n.rlike(KEY_PATTERN) & ~n.rlike(DEVICE_PATTERN)
    return F.coalesce(~key & ~n.rlike(SAFE_PATTERN) & n.rlike(SENSITIVE_PATTERN), F.lit(False))


def is_temporal(name: Column, data_type: Column) -> Column:
    return F.coalesce(F.lower(data_type).rlike("date|time"), F.lit(False)) | F.lower(name).rlike(TEMPORAL_NAME)


def redact_dsn(dsn: Column) -> Column:
    """A connection string without its secrets: the password up to the last at-sign of the authority, the query beside it, and what is
    assigned to a secret's name anywhere. A plain path stays; null is empty."""
    scheme = F.regexp_extract(dsn, r"^(.*?://)", 1)
    rest = F.substring(dsn, F.length(scheme) + 1, F.length(dsn))
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    user, host = F.regexp_extract(authority, r"^(.*)@", 1), F.substring_index(authority, "@", -1)
    name, with_password = F.substring_index(user, ":", 1), F.contains(user, F.lit(":"))
    shown = F.when(with_password, F.concat(F.when(name == "", "***").otherwise(name), F.lit(":***@"))).otherwise(F.concat(user, F.lit("@")))
    tail = F.regexp_replace(F.substring(rest, F.length(authority) + 1, F.length(rest)), r"\?[^#]*", "")
    url = F.when(F.contains(authority, F.lit("@")) & (user != ""), F.concat(scheme, shown, host, tail)).otherwise(dsn)
    return F.when(dsn.contains("://"), F.regexp_replace(url, SECRET_ASSIGNED, "$1=***")).otherwise(F.coalesce(dsn, F.lit("")))


def sanitize(text: Column, limit: int = 2000) -> Column:
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, "")
    return F.when(F.length(clean) > limit, F.concat(F.left(clean, F.lit(limit - 1)), F.lit("…"))).otherwise(clean)


def wrap_untrusted(text: Column) -> Column:
    return F.concat(F.lit("<data>\n"), F.regexp_replace(text, "(?i)</data>", "<\\\\/data>"), F.lit("\n</data>"))


def quote_identifier(name: Column, quote: str = '"') -> Column:
    return F.concat(F.lit(quote), F.replace(name, F.lit(quote), F.lit(quote * 2)), F.lit(quote))


def escape_literal(text: Column) -> Column:
    return F.replace(text, F.lit("'"), F.lit("''"))


def escape_script_json(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("</"), F.lit("<\\/")), F.lit("<!--"), F.lit("<\\!--"))


def slug(id_: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(id_, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), F.lit(150))


def bare(id_: Column) -> Column:
    """An id without its prefix."""
    return F.regexp_replace(id_, "^[^:]*:", "")


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def looks_like_sql(text: Column) -> Column:
    return F.coalesce((F.length(text) >= 12) & text.rlike(SQL_KEYWORD) & text.rlike(SQL_SHAPE), F.lit(False))


def singular(name: Column) -> Column:
    cut = lambda n: F.substring(name, F.lit(1), F.length(name) - n)
    return F.when(name.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(name.endswith("ses") | name.endswith("xes"), cut(2)).when(name.endswith("s") & ~name.endswith("ss"), cut(1)).otherwise(name)
