"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled texts: one of ordinary text, one of the same ordinary
text plus the pieces that mark toxic texts, chosen by evidence.  Where the second compresses a window shorter than the first,
the window holds toxic pieces.  The differences of all windows of a text give a few numbers, and a
logistic curve over these, calibrated on labelled texts that took no part in the dictionaries, gives the
score.
"""

from __future__ import annotations

import math
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from themescope.llm.common import groups_of_rows, stored, text_buffer
from themescope.llm.logistic import Logistic, fit_logistic

#: Bytes of a window; it ends at the next space, or after SLACK more bytes.
WINDOW, SLACK = 56, 32
#: Labelled texts of each class that training looks at, at most; taken in order of the hash of their id.
SAMPLE_ROWS = 4_000
#: Bytes of ordinary words in both dictionaries; it stays small: what matches by chance is noise.
ORDINARY_BYTES, ORDINARY_PIECES = 1_500, 4_000
#: A toxic piece has this much evidence (twice the log likelihood ratio of its rows, far from chance) and this many times the ordinary share.  Evidence grows with the number of labels.
EVIDENCE, PIECE_RATIO = 60.0, 8

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


class Model(NamedTuple):
    """Both dictionaries and the calibrated curve; some ten kilobytes."""

    ordinary: bytes
    toxic: bytes
    curve: Logistic


def _pieces(text: bytes) -> dict[bytes, int]:
    """Words of a text and how they begin, each with the least hash of the three words that it stands in:
    copies of a passage agree in it."""
    out: dict[bytes, int] = {}
    words = _WORD.findall(text)
    for before, word, after in zip([b"", *words], words, [*words[1:], b""]):
        mark = zlib.crc32(b" ".join((before, word, after)))
        for piece in {word[:24], *(word[:n] for n in (4, 5, 6, 7) if len(word) > n)}:
            if mark < out.get(piece, 1 << 32):
                out[piece] = mark
    return out


def _seen(texts: DataFrame) -> DataFrame:
    """(piece, mark, label, half), each once, of texts (label, half, body), which are read whole."""
    def run(batches):
        for batch in batches:
            labels, halves = batch.column("label").to_pylist(), batch.column("half").to_pylist()
            data, offsets = text_buffer(batch.column("body"))
            for i, label in enumerate(labels):
                found = _pieces(data[offsets[i]: offsets[i + 1]].tobytes().lower())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64()),
                     pa.array([label] * len(found), pa.int32()), pa.array([halves[i]] * len(found), pa.int64())],
                    names=["piece", "mark", "label", "half"])

    return texts.select("label", "half", "body").mapInArrow(run, "piece binary, mark long, label int, half long").distinct()


def _counted(seen: DataFrame) -> DataFrame:
    """(piece, n0, n1): rows of each label that hold a piece; rows with the same passage count once."""
    return seen.groupBy("piece").agg(F.sum((F.col("label") == 0).cast("long")).alias("n0"),
                                     F.sum((F.col("label") == 1).cast("long")).alias("n1"))


def dictionaries(counts: DataFrame, rows: tuple[int, int]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary from :func:`_counted` and the rows of each label; in
    each part the weightiest pieces last, where zstandard reaches them with the shortest offsets."""
    common = (counts.filter("n0 > 0").orderBy(F.desc("n0"), F.desc("piece")).limit(ORDINARY_PIECES)
              .select("piece").collect())
    ordinary = b"".join(b" " + bytes(r["piece"]) for r in reversed(common))[-ORDINARY_BYTES:]
    if not min(rows):
        return ordinary, ordinary
    share = rows[1] / sum(rows)
    a, b = F.col("n1"), F.col("n0")

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    evidence = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share))
                    + part(rows[1] - a, (sum(rows) - a - b) * share) + part(rows[0] - b, (sum(rows) - a - b) * (1 - share)))
    marked = (counts.filter(a * rows[0] > PIECE_RATIO * b * rows[1])
              .select("piece", F.round(evidence, 6).alias("evidence")).filter(F.col("evidence") >= EVIDENCE).collect())
    kept: list[bytes] = []
    begun: set[bytes] = set()
    for r in sorted(marked, key=lambda r: (-r["evidence"], -len(r["piece"]), bytes(r["piece"]))):
        piece = bytes(r["piece"])  # keep of a family what says most
        begins = {piece[:n] for n in range(4, len(piece))}
        if piece in begun or begins & set(kept):
            continue
        kept.append(piece)
        begun |= begins
    return ordinary, b"".join(b" " + p + b" " for p in reversed(kept)) + ordinary


def windows(text: bytes):
    """Consecutive windows of a text, cut at spaces where there are some; an empty text has one."""
    at, n = 0, len(text)
    while at < n:
        end = text.find(b" ", at + WINDOW, at + WINDOW + SLACK)
        if end < 0:
            end = min(n, at + WINDOW + SLACK)
        yield text[at:end]
        at = end
    if not n:
        yield b""


def compressor(content: bytes):
    room = max(14, (len(content) + WINDOW + SLACK).bit_length())  # the whole dictionary is within reach
    settings = zstandard.ZstdCompressionParameters(
        compression_level=5, min_match=4, strategy=zstandard.STRATEGY_LAZY2, window_log=room, hash_log=room, chain_log=room - 1,
        search_log=5, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress


class Distances:
    """What a text's windows gain from the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)

    def features(self, text: bytes) -> list[float]:
        ordinary, toxic = self.ordinary, self.toxic
        gain = np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in windows(text)), np.float64)
        top = np.sort(gain)[::-1][:3]
        clear = np.maximum(gain - 2, 0)
        return [top[0], top[-1], clear.mean(), math.log1p(clear.sum()), (gain >= 3).mean(), gain.mean(),
                math.log(len(gain))]


def _features(texts: DataFrame, ordinary: bytes, toxic: bytes) -> DataFrame:
    """(label, turn, x): the numbers of whole texts."""
    def run(batches):
        distances = Distances(ordinary, toxic)
        for batch in batches:
            data, offsets = text_buffer(batch.column("body"))
            x = [distances.features(data[offsets[i]: offsets[i + 1]].tobytes().lower()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("turn"), pa.array(x, pa.list_(pa.float64()))],
                                             names=["label", "turn", "x"])

    return texts.select("label", "turn", "body").mapInArrow(run, "label int, turn long, x array<double>")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` labelled texts of each class whose crc32 of the id as text is
    not divisible by 5.

    Several labels of an id count as their largest; missing ids and labels are left out.  Without labels
    of both kinds the score is the share of toxic labels (0.5 of a row added to each class).  The curve
    is fitted on both halves of the ids, each measured by dictionaries of the other one; the model has
    dictionaries of both.  Tasks read whole texts; only pieces that are kept and
    the numbers of each text come to the driver.
    """
    usable = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
              .filter(~held_out(F.col(id_col))))
    order = F.xxhash64(F.col(id_col).cast("string"))
    chosen = [usable.filter(F.col("label") == k).orderBy(order, id_col).limit(sample_rows) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample_rows ids
    half = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(2))
    rows = (docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("body")).join(ids, id_col)
            .select("label", order.alias("turn"), half.alias("half"), "body"))
    seen = stored(_seen(rows), "toxicity-pieces")
    size = {(r["half"], r["label"]): r["count"] for r in rows.groupBy("half", "label").count().collect()}
    number = lambda halves: tuple(sum(size.get((h, k), 0) for h in halves) for k in (0, 1))
    fit = []
    for half in (0, 1):
        pair = dictionaries(stored(_counted(seen.filter(F.col("half") == 1 - half)), "toxicity-counts"), number([1 - half]))
        fit += _features(rows.filter(F.col("half") == half), *pair).collect()
    fit.sort(key=lambda r: (r["label"], r["turn"], r["x"]))
    every = stored(_counted(seen.drop("half").distinct()), "toxicity-counts")
    x = np.array([r["x"] for r in fit]).reshape(-1, 7)
    return Model(*dictionaries(every, number([0, 1])), fit_logistic(x, np.array([r["label"] for r in fit], np.float64)))


def held_out(key):
    return (F.crc32(key.cast("string").cast("binary")) % 5) == 0


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, score (0 to 1), windows.

    A missing text is an empty one and has one empty window; repeated rows, missing ids and other columns
    pass as they are; an empty table gives none.  One narrow pass over whole texts, window by window.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = sent.value
        distances = Distances(model.ordinary, model.toxic)
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_col))
            for a, b in groups_of_rows(offsets, 1 << 21):
                x = np.array([distances.features(data[offsets[i]: offsets[i + 1]].tobytes().lower()) for i in range(a, b)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).slice(a, b - a), pa.array(model.curve.probability(x)),
                     pa.array(np.rint(np.exp(x[:, 6])).astype(np.int64))], names=[id_col, "score", "windows"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, windows long")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """id_col, held_out, score, predicted, windows for every row of ``docs``; see the two steps above."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels, id_col, text_col, label_col, sample_rows), id_col, text_col)
    return scored.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "windows")
