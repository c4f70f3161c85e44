"""Language identification by hierarchical discrimination.

A linear classifier first predicts the language family of a text; within the family, one linear
support vector machine per pair of languages votes. Features are hashed counts of one to three
neighbouring bytes of the lower-cased letters of the whole text.

The models are fitted on the driver from a bounded sample: at most `per_language` rows of each
language and `MAX_SAMPLE` rows in all, taken by hash from all labelled rows. Features are made on the
executors, for the sample as for all other rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentguard.llm.shared import bounded_batches

DIM = 2048
MAX_SAMPLE = 4000
PER_LANGUAGE = 400
UNDETERMINED = "und"
_BLOCK = 1 << 20

#: Facts about languages by their two-letter code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "finnic": "fi et",
    "turkic": "tr az kk ky uz tt",
    "indo-aryan": "hi ur bn mr pa gu ne",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Unit vector of hashed byte n-grams (n = 1 to 3) of a whole text, block by block."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY).split()) + b" "
    total = np.zeros(DIM, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(raw), _BLOCK):
        b = raw[at:at + _BLOCK + 2].astype(np.uint32)
        own = min(len(b), _BLOCK)
        grams = [b[:own]]
        for n in (2, 3):
            m = min(own, len(b) - n + 1)
            if m > 0:
                g = b[:m].copy()
                for k in range(1, n):
                    g = g * np.uint32(257) + b[k:m + k] + np.uint32(1)
                grams.append(g)
        for n, g in enumerate(grams):
            h = (g + np.uint32(n * 0x51ED27)) * np.uint32(2654435761)
            total += np.bincount(h >> np.uint32(21), minlength=DIM)
    x = np.sqrt(total)
    return (x / max(1e-9, float(np.sqrt((x * x).sum())))).astype(np.float32)


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge, classes weighted alike), by accelerated gradient."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float32)
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = before = np.zeros(x.shape[1], dtype=np.float32)
    penalty, step = np.float32(penalty), np.float32(1 / (penalty + 4))
    for k in range(rounds):
        ahead = w + np.float32(k / (k + 3)) * (w - before)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        before, w = w, ahead - step * (penalty * ahead - 2 * (weight * y * slack) @ x)
    return w


def squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * margin, -50, 50)))


@dataclass
class LanguageModel:
    """Families with one-versus-rest weights; per family its languages and one-versus-one weights."""

    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]

    @staticmethod
    def fit(x: np.ndarray, langs: list[str]) -> LanguageModel:
        known = sorted(set(langs))
        own = {f: [a for a in known if family(a) == f] for f in sorted({family(a) for a in known})}
        names = list(own)
        of = np.array([names.index(family(a)) for a in langs])
        labels = np.array(langs, dtype=object)
        rest = 1 if len(names) == 2 else len(names)
        weights = [fit_linear(x, np.where(of == k, 1.0, -1.0)) for k in range(rest)] if len(names) > 1 else []
        if len(names) == 2:
            weights.append(-weights[0])
        pairs: dict[str, list[tuple[int, int, np.ndarray]]] = {}
        for f, members in own.items():
            pairs[f] = []
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    rows = np.flatnonzero((labels == a) | (labels == members[j]))
                    pairs[f].append((i, j, fit_linear(x[rows], np.where(labels[rows] == a, 1.0, -1.0))))
        return LanguageModel(names, np.array(weights), own, pairs)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row: the share of its family times the mean vote within it."""
        n = len(x)
        if not self.families or not n:
            return np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
        if len(self.families) > 1:
            chance = squash(x @ self.family_weights[:, :-1].T + self.family_weights[:, -1])
            best = chance.argmax(axis=1)
            share = chance[np.arange(n), best] / chance.sum(axis=1)
        else:
            best, share = np.zeros(n, dtype=int), np.ones(n)
        langs, score = np.empty(n, dtype=object), np.zeros(n)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            members = self.languages[f]
            votes, soft = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for i, j, w in self.pairs[f]:
                p = squash(x[rows] @ w[:-1] + w[-1])
                soft[:, i] += p
                soft[:, j] += 1 - p
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
            if len(members) == 1:
                langs[rows], score[rows] = members[0], share[rows]
                continue
            win = (votes + soft / len(members)).argmax(axis=1)
            langs[rows] = np.array(members, dtype=object)[win]
            score[rows] = share[rows] * soft[np.arange(len(rows)), win] / (len(members) - 1)
        return langs, np.clip(score, 0, 1)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: CRC-32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit from rows with a language and a text that has a letter; other rows are passed over.

    `per_language` bounds the rows taken of each language, drawn by a hash of id and text, so rows without an id, or with one id,
    are drawn like others; equal rows are drawn together, as often as there is room. Languages are counted over all rows; one
    row per language comes to the driver, and at most MAX_SAMPLE feature rows.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((0, DIM + 1)), {}, {})
    each = max(1, min(per_language, MAX_SAMPLE // len(counts)))
    rate = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        rate = F.when(F.col(lang_col) == lang, min(1.0, 1.2 * each / n)).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.where(draw < rate).select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.col(text_col).alias("text"))
    # Tasks hand on no more than `each` rows of a language, however many copies are drawn at once.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))
    chosen = drawn.withColumn("place", place).where(F.col("place") <= each).drop("place")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            langs, draws, texts = (c.to_pylist() for c in batch.columns)
            keep = [k for k, t in enumerate(texts) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([
                pa.array([langs[k] for k in keep], pa.string()), pa.array([draws[k] for k in keep], pa.float64()),
                pa.array([features(texts[k]).astype(np.float16).tobytes() for k in keep], pa.binary())], names=["lang", "draw", "x"])

    rows = sorted(bounded_batches(chosen).mapInArrow(run, "lang string, draw double, x binary").collect(), key=lambda r: (r["lang"], r["draw"], r["x"]))
    taken: dict[str, int] = {}
    langs, xs = [], []
    for r in rows:
        if taken.get(r["lang"], 0) < each:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            langs.append(r["lang"])
            xs.append(np.frombuffer(r["x"], dtype=np.float16))
    if not xs:
        return LanguageModel([], np.zeros((0, DIM + 1)), {}, {})
    return LanguageModel.fit(np.stack(xs).astype(np.float32), langs)


def prediction(spark, model: LanguageModel, text: Column) -> Column:
    """Struct of lang_pred and score for a text column."""
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(schema)
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        langs, scores = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
        at = np.array([k for k, t in enumerate(texts) if has_letter(t)], dtype=int)
        for part in range(0, len(at), 512):
            rows = at[part:part + 512]
            langs[rows], scores[rows] = own.predict(np.stack([features(texts.iat[k]) for k in rows]))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    Learns from the documents' own labels where they are not held out, then predicts every
    text from itself alone. A text that is null or has no letter, and every text where nothing could be learned,
    is `und` with score 0. Repeated rows stay; an empty table gives an empty result; other columns
    are not read.
    """
    model = train(docs.where(~held_out(id_col)), text_col, lang_col, id_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), prediction(docs.sparkSession, model, F.col(text_col)).alias("p"))
    return rows.select(id_col, "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language can be told; rejected are those predicted `und`. Columns stay."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col, id_col)
    return docs.where(prediction(docs.sparkSession, model, F.col(text_col))["lang_pred"] != UNDETERMINED)
