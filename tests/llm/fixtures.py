"""Small documents with every awkward case: nulls, empties, long, repeated rows, odd characters."""

from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977} x{i}" for i in range(9000))
TEXTS = [
    None, "", " ", "  ", "\n\n", "a", " a", "a ", "a  b", "\t a\r\n", "▁", "a▁b ▁▁c", "\x00", "é é ﷽😀", "　x y\x85z\x1c",
    "<s> </s> <unk> <0x41>", "it's we'll I'd  don't", "x<|endoftext|>y", " <|endoftext|><|endoftext|> z", "١٢٣ 四五 ½ ²", "a" * 5000, "1" * 3000, LONG,
    "one two three four five six " * 12, "中文字符 日本語 한국어", "​ ﻿", "   lead   and trail   ", "no\n\nblank\nno\n",
]

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.StringType()), T.StructField("kept", T.StringType())])


def rows():
    out = [(i, t, "en", f"s{i % 3}", None, "clash", None) for i, t in enumerate(TEXTS)]
    out += [out[5], out[13], out[-3], (None, "null id here", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return docs(spark, [])
