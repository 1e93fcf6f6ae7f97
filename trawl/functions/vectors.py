"""Vector columns and the embedder extension point."""

from abc import ABC, abstractmethod
from collections.abc import Iterator
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

VECTOR = T.ArrayType(T.FloatType())
PIECE = 256  # texts that are embedded at a time


def dot(a, b):
    """Inner product in double; equals the cosine on unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v):
    return F.sqrt(dot(v, v))


class Embedder(ABC):
    """Text to unit vectors. Subclasses give ``dim`` and ``encode``.

    Only questions carry ``query_prefix``; documents never do. ``encode`` runs
    in Python workers on Arrow batches, so heavy models load lazily there.
    """

    dim: int
    query_prefix: str = ""

    @abstractmethod
    def encode(self, texts: list[str]) -> np.ndarray:
        """An (n, dim) matrix with rows of length one."""

    def documents(self, text):
        return self._udf()(text)

    def questions(self, text):
        return self._udf()(F.concat(F.lit(self.query_prefix), text))

    def _udf(self):
        encode, dim = self.encode, self.dim

        def vectors(batch):
            """Of a piece of the batch at a time: only the batch itself, in Arrow's form, is as large as its texts."""
            for start in range(0, len(batch), PIECE):
                texts = [t or "" for t in batch.slice(start, PIECE).to_pylist()]
                yield np.asarray(encode(texts), dtype=np.float32)

        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                matrix = np.concatenate([np.zeros((0, dim), np.float32), *vectors(batch)])
                starts = np.arange(len(matrix) + 1, dtype=np.int32) * dim
                yield pa.ListArray.from_arrays(starts, matrix.ravel())

        return F.arrow_udf(embed, VECTOR)


class HashedTokens(Embedder):
    """Bag of tokens hashed into ``dim`` buckets: needs no model, and any
    engine with md5 can compute the same vectors."""

    def __init__(self, dim=64):
        self.dim = dim
        self._bucket = {}

    def encode(self, texts):
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            buckets = [self._of(t) for t in re.findall("[a-z0-9]+", text.lower())]
            counts = np.bincount(buckets, minlength=self.dim) if buckets else 0
            out[row] = counts
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=out, where=norms > 0)

    def _of(self, token):
        bucket = self._bucket.get(token)
        if bucket is None:
            if len(self._bucket) > 1_000_000:
                self._bucket.clear()
            bucket = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dim
            self._bucket[token] = bucket
        return bucket


class SentenceModel(Embedder):
    """A sentence-transformers model, loaded once per Python worker."""

    def __init__(self, settings, dim=384, batch_size=32):
        self.dim = dim
        self.query_prefix = settings.query_prefix
        self._name = settings.embedding_model
        self._batch = batch_size
        self._model = None

    def encode(self, texts):
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self._name)
        return self._model.encode(
            texts, normalize_embeddings=True, batch_size=self._batch, show_progress_bar=False
        )
