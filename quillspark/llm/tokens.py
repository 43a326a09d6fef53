"""Token counts with a whole-token shortcut for a SentencePiece BPE model.

Offline proof, made once per task from the model itself:

* no piece holds a space mark after another character, and none holds a line feed, so no merge can
  cross from a word into the space before the next word or over a line feed: those units count alone;
* a vocabulary string that the library encodes alone to exactly one token always counts one.

A text is cut into such units; units in the proven table are counted directly, and only the rest are
merged by the library, once per distinct unit while the bounded memo holds it.  Texts that are outside
the proof's assumptions (they hold the space mark itself) go to the library whole.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, narrow

LIMIT = 4096
MEMO = 800_000
_MARK = "▁"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter(dict):
    """Token counts of units.  A unit that begins with a line feed has no space mark before it; any
    other stands for the unit after a space mark (the model puts one before a text, too)."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit = memo
        self.whole = self._prove()
        self.update(self.whole)

    def _prove(self) -> dict[str, int]:
        sp = self.model
        pieces = [
            sp.id_to_piece(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        ]
        self.separable = not any("\n" in p or (_MARK in p.lstrip(_MARK)) for p in pieces) and sp.encode("\n", out_type=str)[0] == _MARK
        if not self.separable:
            return {}
        words = [p[1:] for p in pieces if p[0] == _MARK and len(p) > 1 and _MARK not in p[1:]]
        # a lone mark, too: the one that stands before a line feed
        alone = {"": 1} if sp.encode(" \n", out_type=str)[0] == _MARK * 2 else {}
        return alone | {w: 1 for w, ids in zip(words, sp.encode(words, num_threads=1)) if len(ids) == 1}

    def learn(self, units: set[str]) -> None:
        """Merge what is neither proven nor remembered, in one call to the library."""
        new = [u for u in units if u not in self]
        if len(self) - len(self.whole) + len(new) > self.limit:
            self.clear()
            self.update(self.whole)
            new = list(units - self.whole.keys())
        # the mark that the model puts before a line feed is a token of its own
        self.update((u, len(ids) - (u[:1] == "\n")) for u, ids in zip(new, self.model.encode(new, num_threads=1)))

    def units(self, text: str) -> list[str] | None:
        """The text's units; None if it is outside the proof and must be encoded whole."""
        if not self.separable or _MARK in text:
            return None
        units = (text.replace("\n", " \n") if "\n" in text else text).split(" ")
        return list(_runs(units)) if "" in units else units

    def count_all(self, texts: list[str | None]) -> list[int]:
        cut = [self.units(t) if t else [] for t in texts]
        self.learn(set().union(*(u for u in cut if u)))
        return [len(self.model.encode(t)) if u is None else sum(map(self.__getitem__, u)) for t, u in zip(texts, cut)]


def _runs(units: list[str]):
    """Join each run of empty units (further spaces) to the word after it; before a line feed or the end it stands alone."""
    spaces = 0
    for unit in units:
        if unit == "":
            spaces += 1
        elif unit[0] == "\n":
            if spaces:
                yield " " * (spaces - 1)
            yield unit
            spaces = 0
        else:
            yield " " * spaces + unit
            spaces = 0
    if spaces:
        yield " " * (spaces - 1)


@functools.lru_cache(maxsize=1)
def counter_for(path: str) -> Counter:
    """One counter for each worker process, kept from task to task."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    Counts equal the library's encoding of the whole text without begin or end tokens; special strings
    inside texts are ordinary text, as is its default.  Null text counts as empty: 0 bytes, 0 tokens.
    Repeated rows and null ids are returned as they come; further columns are ignored.
    """

    def make():
        counter = counter_for(path or model_path())

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            n = counter.count_all(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return step

    return map_texts(narrow(docs, "doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
