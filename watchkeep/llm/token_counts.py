"""Token counts with whole-token shortcuts for a byte-level BPE."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from watchkeep.llm.common import arrow, text_or_empty

# Fixed value: the pre-token pattern of byte-level BPE files that state "use_regex".
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Entries of the memory for merged pre-tokens, per Python worker.
REMEMBERED = 400_000
# Texts counted together.
BATCH = 200


def byte_letters() -> dict[str, int]:
    """Byte behind each letter of a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts the tokens of texts as the tokenizer in ``path`` gives them.

    ``whole`` holds the vocabulary strings proven to be one token alone: the
    pre-tokenizer leaves them whole, and the tokenizer answers with their own
    id.  Pre-tokens found there count one; only the others are merged.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        split = stated["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not plain or stated["normalizer"] or stated["truncation"] or stated["padding"]:
            raise ValueError("whole-token counting needs a byte-level BPE without normaliser, truncation or padding")
        added = stated["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(PATTERN)
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.whole = self._prove(stated["model"]["vocab"])
        self.merged: dict[str, int] = {}

    def _prove(self, vocabulary: dict[str, int]) -> frozenset[str]:
        letters, found = byte_letters(), []
        for name, number in vocabulary.items():
            try:
                text = bytes(letters[c] for c in name).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if self.pattern.findall(text) == [text]:
                found.append((text, number))
        answers = self.tokenizer.encode_batch_fast([t for t, _ in found], add_special_tokens=False)
        return frozenset(t for (t, n), a in zip(found, answers, strict=True) if a.ids == [n])

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; added tokens inside a text count one each."""
        totals, rests = [], []
        for text in texts:
            pieces = [text]
            if self.added is not None and self.added.search(text):
                pieces = self.added.split(text)
            total, rest = len(pieces) - 1, []
            for piece in pieces:
                found = self.pattern.findall(piece)
                others = [t for t in found if t not in self.whole]
                total += len(found) - len(others)
                rest += others
            totals.append(total)
            rests.append(rest)
        known = self.merged
        new = list({t for rest in rests for t in rest if t not in known})
        answers = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        fresh = {t: len(a.ids) for t, a in zip(new, answers, strict=True)}
        if len(known) + len(fresh) <= REMEMBERED:
            known.update(fresh)
            fresh = known
        else:
            fresh.update((t, known[t]) for rest in rests for t in rest if t in known)
        return [total + sum([fresh[t] for t in rest]) for total, rest in zip(totals, rests, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    ``path`` names the tokenizer file on the workers.  Whole texts are counted,
    without tokens for begin or end.  Null and empty texts have no tokens;
    repeated rows give repeated results; ids may be null; an empty table gives
    no rows; other columns are not read.
    """
    def run(batch):
        ids, texts = batch.column("doc_id"), batch.column("text")
        count = counter(path)
        for begin in range(0, len(ids), BATCH):
            part = texts.slice(begin, BATCH)
            yield {
                "doc_id": ids.slice(begin, BATCH), "n_bytes": pc.binary_length(part).cast(pa.int64()),
                "n_tokens": pa.array(count.count(part.to_pylist()), pa.int64()),
            }

    found = arrow(run, docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
