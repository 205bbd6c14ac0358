"""Language identification by a blended-spectrum string kernel.

A text's features are the byte n-grams of one to three bytes that it holds, each
counted once. The kernel of two texts is the number of n-grams in common over
the geometric mean of their numbers. Landmarks give a Nyström map; a one-versus-rest
ridge regression on it scores each language, so a batch of texts is scored by two
matrix products.

The classifier is fitted on every labelled row that isn't held out, over its whole text: the
regression needs only sums over rows, which tasks form and Spark adds up. They are sums of
integers, so that order and partitions don't change the model. The landmarks, a bounded number of
texts, are those in the middles of equal shares of all of a language's rows by size. Every row is scored,
over its whole text.

Edge cases: a null text and one without letters are ``und`` with score 0; with no
labelled rows all texts are ``und``; rows without a label or without an id take no part
in the fit; repeated rows are scored alike; other columns take no part.

A calibrated model also tells texts in no known language: each language has a floor for
the share of a text's three-byte n-grams that the landmarks hold. It is taken from exact quantiles
over all of its labelled rows, of which either half, by a hash, is held against landmarks of the other. Texts that mix known languages score low, but hold known n-grams,
and stay. With fewer than ``FEWEST_ROWS`` such rows there are no floors, and ``keep``
rejects only texts without letters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm.arrow import batch_of, id_and_bytes, pairs
from lithos.operators.slices import order_statistics, quantiles

#: Landmarks over all languages; each language has one at least.
LANDMARKS = 96
RIDGE = 0.1
#: Landmarks are chosen of either half of the rows and of all.
WHOLE = 2
#: Rows that a floor is taken from, at least; their quantile; how far below it the floor lies, in distances from there to the median, and at least.
FEWEST_ROWS, FLOOR_QUANTILE, FLOOR_SLACK, LEAST_SLACK = 8, 0.01, 1.5, 0.15
UNKNOWN = "und"
#: Lower case for ASCII; everything but letters and bytes of other characters is a word's edge.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letters(data: bytes | None) -> bool:
    if not data:
        return False
    return bool(_ASCII_LETTER.search(data)) or (not data.isascii() and any(map(str.isalpha, data.decode("utf-8", "replace"))))


def codes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all n-grams of one, two and three bytes, with an edge before and after the text."""
    b = np.frombuffer(b" " + data.translate(_FOLD) + b" ", np.uint8).astype(np.int32)
    two = (b[:-1] << 8) | b[1:]
    return b, two, (two[:-1] << 8) | b[2:]


@dataclass
class Vocabulary:
    """The landmarks' n-grams, each with its column."""

    grams: tuple[np.ndarray, np.ndarray, np.ndarray]

    def __post_init__(self) -> None:
        self.size = sum(map(len, self.grams))
        self.tables: list[np.ndarray] | None = None

    def presence(self, data: bytes, row: np.ndarray) -> float:
        """Set ``row`` to 1 at the columns of the n-grams in ``data``; the last column takes the others.

        Returned is the share of the n-grams of three bytes that have a column, each time counted.
        """
        if self.tables is None:
            self.tables, at = [], 0
            for n, own in enumerate(self.grams, 1):
                t = np.full(1 << 8 * n, self.size, np.int16 if self.size < 32_000 else np.int32)
                t[own] = np.arange(at, at + len(own))
                at += len(own)
                self.tables.append(t)
        for table, found in zip(self.tables, codes(data), strict=True):
            at = table[found]
            row[at] = 1
        return float((at != self.size).mean()) if len(at) else 0.0


@dataclass
class Model:
    languages: list[str]
    vocabulary: Vocabulary
    landmarks: np.ndarray  # n-grams x landmarks
    norms: np.ndarray
    weights: np.ndarray  # landmarks x languages

    #: For each language the share of known n-grams below which a text is in no known language.
    floors: np.ndarray | None = None

    def kernel(self, texts: list[bytes]) -> np.ndarray:
        return self._kernel(texts)[0]

    def _kernel(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        p = np.zeros((len(texts), self.vocabulary.size + 1), np.float32)
        known = np.array([self.vocabulary.presence(data, row) for row, data in zip(p, texts, strict=True)])
        p = p[:, :-1]
        own = np.sqrt(np.maximum(p.sum(axis=1), 1))
        return (p @ self.landmarks) / (own[:, None] * self.norms[None, :]), known

    def evidence(self, texts: list[bytes], step: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language of each text, by its place, its score and its share of known n-grams."""
        said, found = [np.zeros(0, int)], [np.zeros((0, 2))]
        for i in range(0, len(texts), step):
            kernel, known = self._kernel(texts[i : i + step])
            scores = kernel @ self.weights
            said.append(scores.argmax(axis=1))
            found.append(np.stack([np.clip((scores.max(axis=1) + 1) / 2, 0, 1), known], axis=1))
        return np.concatenate(said), *np.concatenate(found).T

    def predict(self, texts: list[bytes], step: int = 64) -> list[tuple[str, float]]:
        said, scores, _ = self.evidence(texts, step)
        return [(self.languages[k], float(s)) for k, s in zip(said, scores, strict=True)]

    def knows(self, texts: list[bytes], min_score: float = 0.0) -> np.ndarray:
        """True for texts in a language of the model."""
        said, scores, known = self.evidence(texts)
        ok = scores >= min_score
        return ok if self.floors is None else ok & (known >= self.floors[said])


def basis(marks: list[bytes], languages: list[str]) -> Model:
    """A model of these landmarks, still without weights."""
    found = [codes(m) for m in marks]
    vocabulary = Vocabulary(tuple(np.unique(np.concatenate([f[n] for f in found])) for n in range(3)))
    at = np.zeros((len(marks), vocabulary.size + 1), np.float32)
    for row, data in zip(at, marks, strict=True):
        vocabulary.presence(data, row)
    at = at[:, :-1]
    return Model(languages, vocabulary, np.ascontiguousarray(at.T), np.sqrt(np.maximum(at.sum(axis=1), 1)), np.zeros((len(marks), len(languages))))


def scales(counts: list[int]) -> np.ndarray:
    """What the kernels of each language's rows are multiplied by before they are rounded.

    Its square is in proportion to a row's weight, which is one over the language's rows, as languages weigh alike. Products
    summed over a batch stay exact as doubles, those over all rows within a long.
    """
    least = min(counts)
    return min(2.0**22, math.sqrt(2.0**62 / (len(counts) * least))) * np.sqrt(least / np.array(counts, float))


def sums(model: Model, scale: np.ndarray, label: np.ndarray, texts: list[bytes], step: int = 64) -> np.ndarray:
    """Of the scaled kernels: the products of each two landmarks, then a row for each language; summed over the texts."""
    m = len(model.norms)
    out = np.zeros((m + len(scale), m), np.int64)
    for i in range(0, len(texts), step):
        own = label[i : i + step]
        scaled = np.rint(model.kernel(texts[i : i + step]).astype(np.float64) * scale[own][:, None])
        out[:m] += (scaled.T @ scaled).astype(np.int64)
        np.add.at(out[m:], own, scaled.astype(np.int64))
    return out


def solve(model: Model, counts: list[int], total: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The weights, from ``sums`` over all rows."""
    m, scale = len(model.norms), scales(counts)
    at = model.landmarks
    among = ((at.T @ at) / (model.norms[:, None] * model.norms[None, :])).astype(np.float64)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    value = np.maximum(value, 1e-6 * value.max())
    to_map = vector / np.sqrt(value)  # the Nyström map of a text is its kernel with the landmarks times this
    unit = sum(counts) / len(counts) / counts[0] / scale[0] ** 2  # a row weighs 1 in the mean
    gram = to_map.T @ (unit * total[:m]) @ to_map
    target = 2 * np.eye(len(counts)) - 1
    toward = to_map.T @ ((unit * scale[:, None] * total[m:]).T @ target)
    return to_map @ np.linalg.solve((gram + gram.T) / 2 + ridge * np.eye(m), toward)


def fit(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on local (language, text) rows, as ``train`` does on a table; None if there are none."""
    rows = [(lang, data) for lang, data in rows if has_letters(data)]
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return None
    each = max(1, landmarks // len(languages))
    marks: list[bytes] = []
    for lang in languages:
        own = sorted((data for x, data in rows if x == lang), key=len)
        marks += [own[i] for i in sorted({(2 * k + 1) * len(own) // (2 * each) for k in range(each)})]
    model, place = basis(marks, languages), {lang: k for k, lang in enumerate(languages)}
    label = np.array([place[lang] for lang, _ in rows])
    counts = np.bincount(label).tolist()
    model.weights = solve(model, counts, sums(model, scales(counts), label, [data for _, data in rows]), ridge)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows that no fit may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, text as bytes, size, half) of all rows to learn from: those with id, label and letters that aren't held out."""
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col) & F.col(text_col).rlike(r"\p{L}"))
    half = F.pmod(F.xxhash64(id_col, text_col), F.lit(2)).cast("int")
    return rows.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"), F.octet_length(text_col).alias("size"), half.alias("half"))


def choose(rows: DataFrame, each: int, halves: bool) -> dict[int, list[tuple[str, bytes]]]:
    """(language, text) of the landmarks of all ``labelled`` rows and, with ``halves``, of those of either half.

    A language's rows in order of size are cut into ``each`` equal shares, from whose middles they come; of rows of one size the first by a hash.
    """
    parts = F.array(F.lit(WHOLE), "half") if halves else F.array(F.lit(WHOLE))
    sized = rows.select(F.explode(parts).alias("part"), "lang", "size")
    middles = [F.floor(F.lit(2 * k + 1) * F.col("n") / F.lit(2 * each)) for k in range(each)]
    sizes = order_statistics(sized, ["part", "lang"], "size", middles).select("part", "lang", F.explode("values").alias("size"))
    wanted = sizes.groupBy("part", "lang", "size").agg(F.count(F.lit(1)).alias("wanted"))  # as many as there are landmarks
    near = rows.join(F.broadcast(wanted), ["lang", "size"]).filter(F.col("part").isin(WHOLE) | (F.col("part") == F.col("half")))
    w = Window.partitionBy("part", "lang", "size").orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id", "text")
    first = near.withColumn("turn", F.row_number().over(w)).filter((F.col("turn") <= each) & (F.col("turn") <= F.col("wanted")))
    marks: dict[int, list[tuple[str, bytes]]] = {}
    for r in sorted(first.select("part", "lang", "size", "turn", "text").collect(), key=lambda r: r[:4]):  # three times the landmarks at most
        marks.setdefault(r["part"], []).append((r["lang"], bytes(r["text"])))
    return marks


def total_sums(rows: DataFrame, model: Model, scale: np.ndarray) -> np.ndarray:
    """``sums`` over all ``labelled`` rows."""
    m = len(model.norms)
    shared = rows.sparkSession.sparkContext.broadcast((model, scale))  # bounded by the landmarks' n-grams
    names = [f"v{k}" for k in range(m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scale = shared.value
        place = {lang: k for k, lang in enumerate(model.languages)}
        out = np.zeros((m + len(scale), m), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                out += sums(model, scale, np.array([place[x] for x in few.column("lang").to_pylist()]), few.column("text").to_pylist())
        used = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(out[used, k]) for k in range(m))], names=["place", *names])

    parts = rows.select("lang", "text").mapInArrow(run, "place int, " + ", ".join(f"{n} long" for n in names))
    total = np.zeros((m + len(scale), m), np.int64)
    for r in parts.groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).collect():
        total[r["place"]] = r[1:]
    return total


def known_shares(rows: DataFrame, marks: list[list[tuple[str, bytes]]]) -> DataFrame:
    """(lang, share) of all ``labelled`` rows: the share of its n-grams of three bytes that landmarks of the other half hold.

    Rows in a language that the other half doesn't have are left out.
    """
    grams = [np.unique(np.concatenate([codes(data)[2] for _, data in own])) for own in marks]
    shared = rows.sparkSession.sparkContext.broadcast((grams, [{lang for lang, _ in own} for own in marks]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, languages = shared.value
        held = np.zeros(1 << 24, np.uint8)  # a bit for each half
        for half, own in enumerate(grams):
            held[own] |= 1 << half
        out = pa.schema([("lang", pa.string()), ("share", pa.float64())])
        for batch in batches:
            langs, halves, texts = (batch.column(c) for c in ("lang", "half", "text"))
            others = [(i, lang, 1 - half) for i, (lang, half) in enumerate(zip(langs.to_pylist(), halves.to_pylist(), strict=True)) if lang in languages[1 - half]]
            yield batch_of(((lang, float((held[codes(texts[i].as_py())[2]] >> other & 1).mean())) for i, lang, other in others), out)

    return rows.select("lang", "half", "text").mapInArrow(run, "lang string, share double")


def floors(rows: DataFrame, languages: list[str], marks: list[list[tuple[str, bytes]]]) -> np.ndarray | None:
    """The floors of each language, over all ``labelled`` rows; ``marks`` are the landmarks of either half.

    A language with too few rows gets the lowest floor of the others.
    """
    if not all(marks):
        return None
    shares, at = known_shares(rows, marks), [FLOOR_QUANTILE, 0.5]
    found = {r["lang"]: r for r in quantiles(shares, ["lang"], "share", at).collect()}

    def floor(low: float, middle: float) -> float:
        return low - max(FLOOR_SLACK * (middle - low), LEAST_SLACK)

    if sum(r["n"] for r in found.values()) < FEWEST_ROWS:
        return None
    of = {lang: floor(*r["quantiles"]) for lang, r in found.items() if r["n"] >= FEWEST_ROWS}
    least = min(of.values()) if of else floor(*quantiles(shares.select(F.lit("").alias("lang"), "share"), ["lang"], "share", at).first()["quantiles"])
    return np.array([of.get(lang, least) for lang in languages])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", calibrate: bool = False) -> Model | None:
    """Fit on all labelled rows that aren't held out; ``calibrate`` adds the floors of a known language."""
    rows = labelled(docs, id_col, text_col, lang_col)
    of = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(of)
    if not languages:
        return None
    counts = [of[lang] for lang in languages]
    marks = choose(rows, max(1, LANDMARKS // len(languages)), calibrate)
    model = basis([data for _, data in marks[WHOLE]], languages)
    model.weights = solve(model, counts, total_sums(rows, model, scales(counts)))
    if calibrate:
        model.floors = floors(rows, languages, [marks.get(half, []) for half in (0, 1)])
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks' n-grams
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = pa.schema([batch.schema.field("doc_id"), ("lang_pred", pa.string()), ("score", pa.float64())])
            for at in range(0, batch.num_rows, 256):
                rows = list(pairs(batch.slice(at, 256)))
                good = [i for i, (_, data) in enumerate(rows) if m is not None and has_letters(data)]
                said = dict(zip(good, m.predict([rows[i][1] for i in good]), strict=True)) if good else {}
                yield batch_of([(doc_id, *said.get(i, (UNKNOWN, 0.0))) for i, (doc_id, _) in enumerate(rows)], out)

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def keep(docs: DataFrame, model: Model | None, min_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known (with at least ``min_score``, and by the floors of a calibrated model), with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x.as_py() for x in batch.column(batch.schema.get_field_index(text_col))]
                data = [x.encode() if x is not None else None for x in texts]
                good = [i for i, x in enumerate(data) if m is not None and has_letters(x)]
                ok = np.zeros(batch.num_rows, bool)
                if good:
                    ok[good] = m.knows([data[i] for i in good], min_score)
                yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
