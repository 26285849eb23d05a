"""Language ID by compression: the language whose dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, small_batches

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: zstandard level of every encoding, and bytes of a text that are encoded on their own: so a long text's own words do
#: not take the dictionary's place.
LEVEL, BLOCK = 6, 1024


def body(text: str) -> bytes:
    """What is encoded: the whole text in lower case."""
    return text.lower().encode("utf-8", "surrogatepass")


def learn(docs: DataFrame, *, dict_docs: int = 400, piece_chars: int = 8192, dict_bytes: int = 112 * 1024, labels: int = 200) -> dict[str, bytes]:
    """A raw-content dictionary for each label of ``lang``.

    A bounded sample of labelled rows: of each of the ``labels`` most frequent labels (ties by code point) ``dict_docs``
    documents by hash, of each at most ``piece_chars`` code points, together at most ``dict_bytes`` bytes. Null labels, null texts and texts without a
    letter teach nothing. The sample is thinned by each label's count before any ranking, so a hot label costs no more.
    """
    rows = docs.select("lang", "text", F.xxhash64("doc_id", F.lit("lang")).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = dict(docs.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(labels).collect())
    if not counts:
        return {}
    share = F.try_element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, 2.0 * dict_docs / n)]), F.col("lang"))
    u = F.shiftrightunsigned(F.col("h"), 11).cast("double") * F.lit(2.0**-53)
    rows = rows.where(u < share)  # null, and so out, for labels beyond the most frequent
    rows = rows.select("lang", "h", F.substring("text", 1, piece_chars).alias("piece"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))
    sample = rows.withColumn("nth", nth).where(F.col("nth") <= dict_docs).orderBy("lang", "nth").toPandas()
    found = {}
    for lang, group in sample.groupby("lang", sort=True):
        content = b" ".join(body(piece) for piece in group.piece if _LETTER.search(piece))[:dict_bytes]
        if content:
            found[lang] = content
    return found


def _coders(dictionaries: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    made = {}
    for lang in sorted(dictionaries):
        d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made[lang] = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return made


def predictor(dictionaries: dict[str, bytes]):
    """A pandas UDF: text to (lang_pred, score, margin). Equal sizes go to the first label by code point."""
    coders: dict[str, zstandard.ZstdCompressor] = {}

    def one(text: str | None) -> tuple[str, float, float]:
        if not dictionaries or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        if not coders:
            coders.update(_coders(dictionaries))
        raw = body(text)
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        sizes = sorted((sum(map(len, map(c.compress, blocks))), lang) for lang, c in coders.items())
        best, second = sizes[0][0], sizes[min(1, len(sizes) - 1)][0]
        score = 1.0 / sum(2.0 ** -min(s - best, 1000) for s, _ in sizes)
        return sizes[0][1], score, (second - best) / second if len(sizes) > 1 else 1.0

    @F.pandas_udf("lang_pred string, score double, margin double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score", "margin"])

    return predict.asNondeterministic()  # else a filter on its result would run it twice


def held_out(doc_id: Column) -> Column:
    """The documents that nothing is learned from: crc32 of the id as text, mod 4, is 2."""
    return id_crc(doc_id) % 4 == 2


def classify(docs: DataFrame, *, min_margin: float = 0.002, **sample) -> DataFrame:
    """``docs`` with held_out, lang_pred, score, margin and rejected; ``sample`` goes to ``learn``.

    rejected: no prediction, or the two smallest encodings differ by less than ``min_margin`` of the second. Null texts
    and texts without a letter are ``und`` with score 0 and rejected, as is everything if nothing could be learned.
    Score: 1 over the sum over languages of 2 to the minus excess bytes. Repeated rows get equal results.
    Columns of ``docs`` with these names are replaced; all others stay, whatever their names.
    """
    small_batches(docs.sparkSession)
    new = ("held_out", "lang_pred", "score", "margin", "rejected")
    predict = predictor(learn(docs.where(~held_out(F.col("doc_id"))), **sample))
    out = docs.select(F.struct(*[c for c in docs.columns if c not in new]).alias("row"), predict(docs["text"]).alias("p"))
    rejected = (F.col("p.lang_pred") == UNKNOWN) | (F.col("p.margin") < min_margin)
    return out.select("row.*", held_out(F.col("row.doc_id")).alias("held_out"), "p.lang_pred", "p.score", "p.margin", rejected.alias("rejected"))
