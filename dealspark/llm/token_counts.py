"""Token counts by a two-tier lookup of pre-tokens on the map side."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_texts, typed

MODEL = "piece_bpe_32k.model"
#: A pre-token is a run of spaces and what follows up to the next: no piece of the vocabulary holds a space mark after
#: another character, so no merge crosses this border.
PRE = re.compile(r" +[^ ]*|[^ ]+")
FREQUENT, SAMPLE_DOCS, CACHE, LONG = 20_000, 1_000, 200_000, 64


@functools.cache
def tokenizer(model: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))


def splits_at_spaces(model: str) -> bool:
    """Whether the model's counts are the sums of its pre-tokens': no piece with a space mark inside, and text kept as it is."""
    tok = tokenizer(model)
    inside = any("▁" in tok.id_to_piece(i).lstrip("▁") for i in range(tok.get_piece_size()))
    kept = tok.encode("a  b ", out_type=str) != tok.encode("a b", out_type=str)
    return not inside and kept


def pre_tokens(text: str) -> list[str]:
    return PRE.findall(" " + text.replace("▁", " ")) if text else []


def _encode(tok, pieces: list[str]) -> list[int]:
    """The library puts a space before each input, so the pre-token's first space is left to it; a lone space is one."""
    got = tok.encode([p[1:] for p in pieces], num_threads=1)
    alone = len(tok.encode("a ")) - len(tok.encode("a"))
    return [len(x) if p != " " else alone for p, x in zip(pieces, got, strict=True)]


def frequent_lengths(documents: DataFrame, model: str = MODEL, sample_docs: int = SAMPLE_DOCS, most: int = FREQUENT) -> dict[str, int]:
    """The compact table: lengths of the `most` commonest pre-tokens of a few documents. It only saves time."""
    seen: Counter = Counter()
    rows = documents.where(F.length("text").between(1, 20_000)).select("text").limit(sample_docs)
    for (text,) in rows.collect():
        seen.update(p for p in pre_tokens(text) if len(p) <= LONG)
    common = [p for p, _ in seen.most_common(most)]
    return dict(zip(common, _encode(tokenizer(model), common), strict=True)) if common else {}


def count_tokens(documents: DataFrame, model: str = MODEL, limit: int = 4096, sample_docs: int = SAMPLE_DOCS, most: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    Tier one is a broadcast table of at most `most` pre-tokens; what it misses is encoded once per worker and kept in a
    bounded cache. Pre-tokens are never shuffled. A model whose pieces may cross spaces is run on the whole text instead.
    Null text: 0 bytes, 0 tokens. Null or repeated ids: a row each. Extra columns are not read.
    """
    spark = documents.sparkSession
    whole = not splits_at_spaces(model)
    first = spark.sparkContext.broadcast({} if whole else frequent_lengths(documents, model, sample_docs, most))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, common, cache = tokenizer(model), first.value, {}
        for batch, texts in blocks(batches, "text"):
            strings = [t.decode("utf-8", "replace") for t in texts]
            if whole:
                n = [len(tok.encode(s, num_threads=1)) for s in strings]
            else:
                split = [pre_tokens(s) for s in strings]
                missing = {p for ps in split for p in ps if p not in common and p not in cache}
                if len(cache) + len(missing) > CACHE:
                    cache.clear()
                    missing = {p for ps in split for p in ps if p not in common}
                todo = list(missing)
                fresh = dict(zip(todo, _encode(tok, todo), strict=True))
                cache.update(fresh)
                n = [sum([common[p] if p in common else cache[p] for p in ps]) for ps in split]
                for p in todo:
                    if len(p) > LONG:
                        del cache[p]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    own = documents.select("doc_id", "text")
    return map_texts(own, run, typed(own.drop("text"), "n_bytes long, n_tokens long, over_limit boolean"))
