"""Order-preserving integer codes of doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


def encode_array(x: np.ndarray) -> np.ndarray:
    """int64 codes in the order of the doubles: -0.0 equals 0.0, and every NaN is one greatest code."""
    x = np.where(x == 0, 0.0, np.asarray(x, np.float64))
    bits = np.where(np.isnan(x), np.float64("nan"), x).view(np.int64)
    code = np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))
    return np.where(np.isnan(x), np.int64(0x7FF8000000000000), code)


def decode_array(code: np.ndarray) -> np.ndarray:
    code = np.asarray(code, np.int64)
    return np.where(code >= 0, code, code ^ np.int64(0x7FFFFFFFFFFFFFFF)).view(np.float64)


@F.pandas_udf(LongType())
def order_code(v: pd.Series) -> pd.Series:
    """The code of each double; null stays null."""
    return pd.Series(encode_array(v.to_numpy(np.float64, na_value=np.nan))).where(v.notna() | True)


@F.pandas_udf(DoubleType())
def order_value(code: pd.Series) -> pd.Series:
    return pd.Series(decode_array(code.to_numpy(np.int64)))


def unsigned_prefix(code: Column, bits_left: int) -> Column:
    """The high bits of a code shifted to unsigned order, all but the lowest ``bits_left``."""
    return F.shiftrightunsigned(code.bitwiseXOR(F.lit(-(2**63))), bits_left)
