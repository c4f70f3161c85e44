"""JSON helpers. Three checks have no exact built-in and run as Arrow batches; each is guarded
so that rows which cannot need it skip it."""

from __future__ import annotations

import json
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A JSON string token, possessive so that long strings do not recurse on the JVM.
STRING_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'

# Argument names that are hidden before hashing (lower case, no _ or -).
SENSITIVE_KEYS = (
    "apikey", "token", "password", "secret", "credentials", "authorization", "bearer", "jwt",
    "privatekey", "clientsecret", "accesskey", "accesstoken", "refreshtoken", "sessionid",
    "creditcard", "cvv", "accountnumber", "routingnumber", "awsaccesskeyid",
    "awssecretaccesskey", "githubtoken", "email", "phone", "ssn",
)
REDACTED = "[REDACTED]"


def _reject(_):
    raise ValueError("not JSON")


@F.pandas_udf(T.StringType())
def _json_status(raw: pd.Series) -> pd.Series:
    def status(text):
        if text is None:
            return "invalid"
        dup = False

        def hook(pairs):
            nonlocal dup
            dup = dup or len({k for k, _ in pairs}) != len(pairs)

        try:
            # Numbers stay text: their size is no reason to refuse a message.
            json.loads(text, object_pairs_hook=hook, parse_constant=_reject, parse_int=str, parse_float=str)
        except (ValueError, RecursionError):
            return "invalid"
        return "duplicate" if dup else "ok"

    return raw.map(status, na_action=None)


def json_status(raw: Column) -> Column:
    """`ok`, `duplicate` (a repeated key at any depth) or `invalid`; NULL counts as invalid.

    The JVM's strict parser, which refuses repeated keys, passes what is one value and nothing
    else. Only the texts it refuses go to Python, to tell repeated keys from other faults.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    one = F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    strict = F.coalesce(one & F.try_parse_json(F.concat(F.lit('{"w":'), raw, F.lit("}"))).isNotNull(), F.lit(False))
    return F.when(strict, F.lit("ok")).otherwise(_json_status(F.when(~strict, raw)))


@F.pandas_udf(T.StringType())
def _nfkc_batch(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC form. Pure ASCII text is already normal, so only the rest is normalised."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(plain, text).otherwise(_nfkc_batch(F.when(~plain, text)))


def flatten_json_strings(params: Column) -> Column:
    """Keys and string values of a JSON text, unescaped, in document order, a space after each."""
    tokens = F.regexp_extract_all(params, F.lit(STRING_TOKEN), F.lit(0))
    values = F.from_json(F.concat(F.lit("["), F.array_join(tokens, ","), F.lit("]")), "array<string>")
    joined = F.concat(F.array_join(values, " "), F.lit(" "))
    return F.when(F.size(tokens) == 0, F.lit("")).otherwise(joined)


def is_sensitive_key(key: Column) -> Column:
    """Name of an argument whose value must not be kept."""
    return F.translate(F.lower(key), "_-", "").isin(*SENSITIVE_KEYS)


def _hide(value):
    if isinstance(value, dict):
        return {
            k: REDACTED if k.lower().replace("_", "").replace("-", "") in SENSITIVE_KEYS else _hide(v)
            for k, v in value.items()
        }
    if isinstance(value, list):
        return [_hide(v) for v in value]
    return value


def _number(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("out of range")
    return value


def _number_text(value: float) -> str:
    """Shortest decimal form; exponents only below 1e-6 and from 1e21 on."""
    if value and not 1e-6 <= abs(value) < 1e21:
        head, _, exponent = repr(value).partition("e")
        return head.removesuffix(".0") + "e" + exponent[0] + exponent[1:].lstrip("0") if exponent else head
    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


#: Signs that are written as escapes inside strings.
_ESCAPES = str.maketrans({c: f"\\u{ord(c):04x}" for c in "<>&\u2028\u2029"})


def canonical_json(value) -> str:
    """Compact JSON with sorted keys, numbers as doubles in their shortest form, and <, >, & escaped."""
    if isinstance(value, dict):
        return "{" + ",".join(canonical_json(k) + ":" + canonical_json(v) for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).translate(_ESCAPES)
    if isinstance(value, float):
        return _number_text(value)
    return json.dumps(value)


@F.pandas_udf(T.StringType())
def redact_json(args: pd.Series) -> pd.Series:
    """Nested arguments with sensitive values hidden, keys sorted; NULL when not a JSON object."""

    def one(text):
        try:
            value = json.loads(text, parse_int=_number, parse_float=_number, parse_constant=_reject)
            return canonical_json(_hide(value)) if isinstance(value, dict) else None
        except (ValueError, TypeError, RecursionError):
            return None

    return args.map(one, na_action="ignore")


def redact_flat_json(args: Column) -> Column:
    """The same for objects without nesting, inside the JVM."""
    parsed = F.from_json(args, "map<string,string>")
    hidden = F.transform_values(parsed, lambda k, v: F.when(is_sensitive_key(k), F.lit(REDACTED)).otherwise(v))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(hidden))))


def hash_arguments(args: Column) -> Column:
    """SHA-256 of the redacted arguments; text that is not an object is hashed as it stands."""
    return F.sha2(F.coalesce(redact_json(args), args), 256)
