"""Token counts with a whole-token shortcut.

Before the job starts, every vocabulary string that ends a word is merged alone; those that come
out as one token are proved to be whole tokens. A pre-token among them counts as one without any
merging; only the other pre-tokens are merged. Counting needs no shuffle: each task reads its own
documents, and remembers the counts of the space-free pieces it has seen, up to a limit.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.llm.common import Cache, id_and_text, map_slices

LIMIT_TOKENS = 2048
#: Characters that some libraries hold for white space and others don't.
UNSURE_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]")


def whole_tokens(tokenizer, suffix: str) -> frozenset[str]:
    """Pre-tokens that merge into exactly one token, proved by merging each candidate."""
    model = tokenizer.model
    bare = (v[: len(v) - len(suffix)] for v in tokenizer.get_vocab(with_added_tokens=False) if v.endswith(suffix))
    return frozenset(b for b in bare if b and len(model.tokenize(b)) == 1)


class PieceCounter:
    """Tokens of a text without white space inside, by the given tokenizer."""

    def __init__(self, tokenizer, whole: frozenset[str], specials: list[str]):
        self.tokenizer, self.whole, self.specials = tokenizer, whole, specials
        self.normal, self.split, self.model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model

    def __call__(self, piece: str) -> int:
        if any(s in piece for s in self.specials):
            return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        text = self.normal.normalize_str(piece) if self.normal else piece
        merge = self.model.tokenize
        return sum(1 if t in self.whole else len(merge(t)) for t, _ in self.split.pre_tokenize_str(text))


def token_counts(docs: DataFrame, path: str, limit_tokens: int = LIMIT_TOKENS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    ``path`` is a tokenizer file whose model is a BPE with a word-end suffix and whose pre-tokens
    never span white space. NULL text counts as empty: 0 bytes, 0 tokens. Repeated rows and equal
    ids give one result each, an empty table gives no rows, other columns are ignored. Very long
    texts are cut at spaces only, so memory follows the longest space-free piece.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        raw = f.read()
    spec = json.loads(raw)
    suffix = spec["model"]["end_of_word_suffix"]
    specials = [a["content"] for a in spec.get("added_tokens", [])]
    if any(re.search(r"\s", s) for s in specials):
        raise ValueError("an added token with white space inside cannot be counted piece by piece")
    shared = docs.sparkSession.sparkContext.broadcast((raw, whole_tokens(Tokenizer.from_str(raw), suffix)))

    def make():
        text, whole = shared.value
        tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        counts = Cache(PieceCounter(tokenizer, whole, specials))

        def step(rows):
            sizes, tokens = [], []
            for t in rows.column("text").to_pylist():
                sizes.append(len(t.encode()))
                pieces = t.split(" ") if UNSURE_SPACE.search(t) else t.split()
                tokens.append(sum(map(counts.__getitem__, pieces)))
            return {"doc_id": rows.column("doc_id"), "n_bytes": sizes, "n_tokens": tokens}

        return step

    counted = map_slices(id_and_text(docs), make, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit_tokens)
