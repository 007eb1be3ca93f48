"""Semantic search over stored vectors, and the bookkeeping of embedding spaces and OCR passes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import classify as K
from quire.functions import numeric as N


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 8, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score): the k rows with the largest product with the unit query, ids on ties; rows count as unit vectors.

    Scores are taken where the rows are; only k rows of each task travel.
    """
    q = np.asarray(query, float)
    norm = float(np.sqrt(q @ q))
    q = q / norm if norm else q
    score = F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(x)) for x in q)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return vectors.select(id_, F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), id_).limit(max(0, k))


def embed(chunks: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", batch: int = 32) -> DataFrame:
    """chunks with vec: the embedder is made once in each worker, texts go through it in batches, vectors get unit length."""

    @F.pandas_udf("array<float>")
    def run(parts: pd.Series) -> pd.Series:
        model, out = make(), []
        for lo in range(0, len(parts), batch):
            v = np.asarray(model(parts.iloc[lo : lo + batch].fillna("").tolist()), float)
            n = np.sqrt((v * v).sum(1, keepdims=True))
            out += list(np.where(n > 0, v / np.where(n > 0, n, 1), v).astype(np.float32))
        return pd.Series(out, dtype=object)

    return chunks.withColumn("vec", run(F.col(text)))


def hashing_embedder(dimension: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A deterministic stand-in for a model: signed counts of hashed words."""

    def make() -> Callable[[list[str]], np.ndarray]:
        import zlib

        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dimension] += 1 if h >> 16 & 1 else -1
            return out

        return run

    return make


def space_sizes(spaces: DataFrame) -> DataFrame:
    """spaces(id, dimension, chunk_ids, payload_bytes) with intact: four bytes for each component of each row."""
    return spaces.withColumn("intact", F.col("payload_bytes") == F.size("chunk_ids").cast("long") * F.col("dimension") * 4)


def fresh_spaces(spaces: DataFrame, fresh: DataFrame) -> DataFrame:
    """spaces(doc_id, id, chunk_ids) with stale: their chunk ids aren't those of fresh(doc_id, chunk_ids)."""
    return spaces.join(fresh.withColumnRenamed("chunk_ids", "_f"), "doc_id", "left").withColumn("stale", ~F.col("chunk_ids").eqNullSafe(F.col("_f"))).drop("_f")


# ---- OCR passes


def ocr_pass(pages: DataFrame, full: Column | int, text: str = "text") -> DataFrame:
    """pages with legible_chars and outcome, the rows of an append-only pass."""
    n = K.legible_chars(F.coalesce(F.col(text), F.lit("")))
    return pages.withColumn("legible_chars", n).withColumn("outcome", K.ocr_outcome(n, full if isinstance(full, Column) else F.lit(full)))


def active_results(results: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The latest row for each key of an append-only table."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pending(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that need recognition and have none."""
    return plan.where("decision <> 'not_needed'").join(done, keys, "left_anti")


def splice(pages: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """pages(html) with the html of fragments where there is one."""
    return pages.join(fragments.withColumnRenamed("html", "_f"), keys, "left").withColumn("html", F.coalesce("_f", "html")).drop("_f")


class Backends:
    """Named recognisers: name -> (factory, tier); a name wins over a tier, a tier over the default."""

    def __init__(self) -> None:
        self._all: dict[str, tuple[Callable[[], Callable[[bytes], str]], str]] = {}

    def register(self, name: str, factory: Callable[[], Callable[[bytes], str]], tier: str = "fast") -> None:
        self._all[name] = (factory, tier)

    def descriptors(self) -> list[tuple[str, str]]:
        return sorted((n, t) for n, (_, t) in self._all.items())

    def get(self, name: str | None = None, tier: str | None = None) -> Callable[[], Callable[[bytes], str]]:
        if name is not None:
            if name not in self._all:
                raise KeyError(f"no backend {name!r}; there are {sorted(self._all)}")
            return self._all[name][0]
        for n, (factory, t) in sorted(self._all.items()):
            if tier is None or t == tier:
                return factory
        raise KeyError(f"no backend of tier {tier!r}")


def recognise(images: DataFrame, factory: Callable[[], Callable[[bytes], str]], image: str = "image") -> DataFrame:
    """images with doctags: the recogniser is made once in each worker."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        model = factory()
        return s.map(lambda x: None if x is None else model(bytes(x)))

    return images.withColumn("doctags", run(F.col(image)))


def closest_ids(ids: DataFrame, wanted: str, n: int = 3, id_: str = "id") -> DataFrame:
    """The n ids most like a mistyped one."""

    @F.pandas_udf("double")
    def ratio(s: pd.Series) -> pd.Series:
        import difflib

        return s.map(lambda x: difflib.SequenceMatcher(None, wanted, x or "").ratio())

    return ids.select(id_, ratio(F.col(id_)).alias("ratio")).orderBy(F.col("ratio").desc(), F.col(id_).desc()).limit(n)


def l2(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.withColumn("unit", N.l2_normalize(F.col(vector)))
