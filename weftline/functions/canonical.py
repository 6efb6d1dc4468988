"""Canonical JSON, signatures and name-based ids: the few functions that Spark has no expression for, as Arrow UDFs."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(x: int | float) -> str:
    """A number as ECMAScript writes it, which canonical JSON asks for."""
    if isinstance(x, int):
        return str(x)
    if math.isnan(x) or math.isinf(x):
        raise ValueError("canonical JSON has no NaN or infinity")
    if x == 0:
        return "0"
    text = repr(abs(x))
    mantissa, _, power = text.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    exponent = len(whole.lstrip("0")) if whole.strip("0") else -(len(part) - len(part.lstrip("0")))
    exponent += int(power or 0)
    digits = digits.rstrip("0") or "0"
    n = len(digits)
    if n <= exponent <= 21:
        out = digits + "0" * (exponent - n)
    elif 0 < exponent <= 21:
        out = f"{digits[:exponent]}.{digits[exponent:]}"
    elif -6 < exponent <= 0:
        out = "0." + "0" * -exponent + digits
    else:
        e = exponent - 1
        out = digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{'+' if e >= 0 else '-'}{abs(e)}"
    return "-" * (x < 0) + out


def canonical(value: object) -> str:
    """JSON with sorted keys (by UTF-16 code units), no spaces, and numbers in their shortest form."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return _number(value)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null stays null, malformed text fails."""
    return text.map(lambda t: None if t is None else canonical(json.loads(t)))


@F.pandas_udf(T.StringType())
def hmac_sha256(text: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else hmac.new(k.encode(), t.encode(), hashlib.sha256).hexdigest() for t, k in zip(text, key, strict=True)])


@F.pandas_udf(T.StringType())
def uuid5(name: pd.Series) -> pd.Series:
    """Name-based ids in the URL namespace."""
    return name.map(lambda n: None if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, n)))
