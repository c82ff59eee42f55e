"""Language identification by compression.

For each language a zstandard dictionary of raw content is made of labelled text. A text belongs to the language whose
dictionary compresses it best; where the best two lie close together, the prediction is marked as rejected. What is
compressed is the whole lower-cased text, in chunks, with each dictionary. A text without a letter (of any script, by its
Unicode category: digits, fractions and numerals are none) has no language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import hashed_share, small_batches, table

_LATIN = re.compile(r"[A-Za-z]")

#: Bytes that are compressed at once, and how fast a byte of difference adds to the certainty.
CHUNK, BYTE_WEIGHT = 8192, 0.35

#: Languages learned in one pass, and those whose compressors (some MB each) a worker holds at once.
BLOCK_LANGUAGES = 64


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LATIN.search(text) is not None or any(c.isalpha() for c in text))


def code_of(text: str | None) -> bytes:
    """What is compressed: the whole text in lower case; empty if it has no letter."""
    return text.lower().encode() if has_letter(text) else b""


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 400, chars_per_doc: int = 600, dictionary_bytes: int = 131_072) -> list[tuple[str, bytes]]:
    """(language, dictionary), most frequent language first.

    The sample of a language is bounded: the docs_per_language documents with the least hash of their id, and of each a
    window of chars_per_doc characters, from a place that the hash picks too. Languages are learned in blocks, one pass
    over the rows for each block. Rows without text or language teach nothing.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col)).count().orderBy(F.desc("count"), lang_col).collect()
    h = F.xxhash64(F.col(id_col).cast("string"))
    window = F.substr(F.col(text_col), (F.pmod(h, F.greatest(F.length(text_col) - chars_per_doc, F.lit(0)) + 1) + 1).cast("int"), F.lit(chars_per_doc))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 32), "h", "t"))
    made: list[tuple[str, bytes]] = []
    for at in range(0, len(counts), BLOCK_LANGUAGES):
        few = F.lit(False)
        for lang, n in counts[at : at + BLOCK_LANGUAGES]:
            few = F.when(F.col(lang_col) == lang, hashed_share(h, docs_per_language, n)).otherwise(few)
        sample = (
            labelled.where(few).select(F.col(lang_col).alias("lang"), h.alias("h"), window.alias("t"))
            .withColumn("k", rank).where(F.col("k") <= docs_per_language).select("lang", "k", "t").collect()
        )
        found: dict[str, dict[str, None]] = {}
        for r in sorted(sample, key=lambda r: (r.lang, r.k)):
            if has_letter(r.t):
                found.setdefault(r.lang, {})[r.t.lower()] = None
        made += [(lang, "\n".join(found[lang]).encode()[-dictionary_bytes:]) for lang, _ in counts[at : at + BLOCK_LANGUAGES] if lang in found]
    return made


class Languages:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        made = zstandard.ZstdCompressionParameters.from_level(6, strategy=zstandard.STRATEGY_LAZY, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.compressors = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=made) for _, d in dictionaries]

    def sizes(self, code: bytes) -> list[int]:
        chunks = [code[i : i + CHUNK] for i in range(0, len(code), CHUNK)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.compressors]


def decide(names: list[str], code: bytes, sizes: np.ndarray) -> tuple[str, float, int]:
    """Language, certainty (0 to 1), and the bytes by which the second-best needs more. Ties go to the more frequent language."""
    if not code or not names:
        return "und", 0.0, 0
    best = int(sizes.argmin())
    score = 1.0 / float(np.exp(-BYTE_WEIGHT * np.minimum(sizes - sizes[best], 1000)).sum())
    margin = int(np.partition(sizes, 1)[1] - sizes[best]) if len(sizes) > 1 else len(code)
    return names[best], score, margin


_LANGUAGES: dict[tuple[int, int], Languages] = {}


def _block(key: int, at: int, size: int, dictionaries: list[tuple[str, bytes]]) -> Languages:
    """The compressors of one block; a worker holds one block at a time."""
    if (key, at) not in _LANGUAGES:
        _LANGUAGES.clear()
        _LANGUAGES[key, at] = Languages(dictionaries[at : at + size])
    return _LANGUAGES[key, at]


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], *, text_col: str = "text", min_margin: int = 2) -> DataFrame:
    """docs with lang_pred ("und" if the text is null or has no letter), lang_score and lang_rejected. Columns of those names are replaced.

    Rejected are texts without a language and those whose second-best language needs less than min_margin bytes more.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    size = BLOCK_LANGUAGES
    key = hash((size, *dictionaries))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for name, _ in dictionaries]
        for batch in batches:
            codes = [code_of(x) for x in batch.column(at).to_pylist()]
            sizes = np.zeros((len(codes), len(names)), dtype=np.int64)
            for k in range(0, len(names), size):
                model = _block(key, k, size, dictionaries)
                for row, code in zip(sizes, codes, strict=True):
                    if code:
                        row[k : k + size] = model.sizes(code)
            got = [decide(names, code, row) for code, row in zip(codes, sizes, strict=True)]
            more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] == "und" or g[2] < min_margin for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = train(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


QUERIES = {"op9_compression_language_id": op9_compression_language_id}
ORACLES: dict[str, str] = {}
