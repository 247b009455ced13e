"""Token counts by a public byte-level BPE; the vocabulary file's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are cut into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def counts(texts: list[str | None], path: str = VOCABULARY) -> list[int]:
    """Tokens of each text; null and empty have none."""
    e = encoding(path)
    return [len(e.encode_ordinary(t)) if t else 0 for t in texts]


def count_batches(keep: list[str], path: str = VOCABULARY, cluster: bool = False):
    """Batches of ``keep`` with ``tokens`` and, if asked for, ``cluster``: equal for texts that fold alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from auditmill.llm import folding

        for b in batches:
            texts = b.column("text")
            arrays = [b.column(k) for k in keep] + [pa.array(counts(texts.to_pylist(), path), pa.int64())]
            names = [*keep, "tokens"]
            if cluster:
                arrays.append(pa.array(folding.combined([texts])[0]))
                names.append("cluster")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run
