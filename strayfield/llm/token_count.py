"""Token counts by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens that no merge can cross. Distinct pre-tokens of a batch are held as one
ragged numpy array of symbol ids; in each round every sequence applies its lowest-rank pair at
all its places at once, until no sequence has a mergeable pair. What survives is counted. Characters
the vocabulary lacks count as their UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NONE = np.int64(1 << 40)
SPACE = "▁"


class PieceMerger:
    """The merge table of a sentencepiece BPE model, and a bounded memory of pre-tokens it has counted."""

    def __init__(self, path: str, remembered: int = 1_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = model.get_score(i)
        runs = {len(p) for p in pieces if not p.strip(SPACE)}
        self.runs, self.longest_run = runs, max(runs, default=1)
        assert all(SPACE not in p.lstrip(SPACE) for p in pieces), "a piece goes on behind a word's end"
        assert not any(len(p) - len(p.lstrip(SPACE)) > 1 and p.strip(SPACE) for p in pieces), "a piece joins a run of spaces to a word"
        names = [p for p in sorted(pieces, key=lambda p: -pieces[p]) if len(p) == 1 or p.strip(SPACE)]
        self.ids = {p: i for i, p in enumerate(names)}
        self.n = len(names)
        pairs = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = i
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.joined = {p[k : k + 2] for p in names for k in range(len(p) - 1)}
        self.remembered = remembered
        self.spaced, self.bare, self.alone = {}, {}, set()

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs make, NONE where they make none. A smaller id is an earlier rank."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left < self.n) & (right < self.n), self.made[at], NONE)

    def survivors(self, words: list[str]) -> list[tuple[int, bool]]:
        """(tokens, whether the first symbol stays alone) of each word."""
        unknown, own = {}, self.ids
        flat, lengths = [], np.fromiter((len(w) for w in words), np.int64, len(words))
        for w in words:
            for c in w:
                i = own.get(c)
                if i is None:
                    i = unknown.setdefault(c, self.n + len(unknown))
                flat.append(i)
        sym = np.array(flat, dtype=np.int64)
        seq = np.repeat(np.arange(len(words)), lengths)
        head = sym[np.concatenate(([0], np.cumsum(lengths)[:-1]))] if len(words) else sym
        done = []
        while len(sym):
            pair = np.full(len(sym), NONE)
            same = seq[:-1] == seq[1:]
            pair[:-1][same] = self.merged(sym[:-1][same], sym[1:][same])
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            sizes = np.diff(np.append(starts, len(sym)))
            low = np.minimum.reduceat(pair, starts)
            over = low == NONE
            if over.any():
                out = np.repeat(over, sizes)
                done.append((seq[out], sym[out]))
                keep = ~out
                sym, seq, pair, low, sizes = sym[keep], seq[keep], pair[keep], low[~over], sizes[~over]
                if not len(sym):
                    break
            hit = pair == np.repeat(low, sizes)
            # in a run of overlapping pairs (a a a) every second one counts, from the left
            at = np.flatnonzero(hit)
            fresh = np.concatenate(([True], np.diff(at) > 1))
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            sym[at] = pair[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        seq = np.concatenate([x for x, _ in done]) if done else np.zeros(0, np.int64)
        sym = np.concatenate([x for _, x in done]) if done else np.zeros(0, np.int64)
        width = np.ones(self.n + len(unknown), np.int64)
        for c, i in unknown.items():
            width[i] = len(c.encode())
        counts = np.bincount(seq, weights=width[sym], minlength=len(words)).astype(np.int64)
        order = np.argsort(seq, kind="stable")
        first = sym[order][np.searchsorted(seq[order], np.arange(len(words)))] if len(words) else sym
        return list(zip(counts.tolist(), (first == head).tolist(), strict=True))

    def run(self, m: int) -> int:
        """Tokens of m spaces that no word takes. All runs have one score, so the leftmost pair goes first: a
        block grows from the left as far as the vocabulary has its length."""
        whole, rest = divmod(m, self.longest_run)
        while rest:
            whole += 1
            rest -= max(k for k in range(1, rest + 1) if all(j in self.runs for j in range(1, k + 1)))
        return whole

    def counted(self, words: list[str]) -> list[tuple[int, bool]]:
        """``survivors`` in batches of bounded size; a long word is cut where no piece has the two characters beside each other."""
        out, batch, size = {}, [], 0
        for w in words:
            if len(w) > 256:
                cuts = [0, *(i for i in range(1, len(w)) if w[i - 1 : i + 1] not in self.joined), len(w)]
                parts = [w[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                got = self.survivors(parts)
                out[w] = (sum(n for n, _ in got), got[0][1] if len(parts[0]) > 1 else True)
                continue
            batch.append(w)
            size += len(w)
            if size > 200_000:
                out.update(zip(batch, self.survivors(batch), strict=True))
                batch, size = [], 0
        out.update(zip(batch, self.survivors(batch), strict=True))
        return [out[w] for w in words]

    def learn(self, spaced: set[str], bare: set[str]) -> None:
        if len(self.spaced) + len(self.bare) > self.remembered:
            for x in (self.spaced, self.bare, self.alone):
                x.clear()
        new = list(spaced - self.spaced.keys())
        for w, (n, alone) in zip(new, self.counted([SPACE + w for w in new]), strict=True):
            self.spaced[w] = n
            if alone:
                self.alone.add(w)
        new = list(bare - self.bare.keys())
        self.bare.update((w, n) for w, (n, _) in zip(new, self.counted(new), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        cut = []  # of each text, its lines as (word without a space before it, words with one)
        spaced, bare = set(), set()
        for t in texts:
            own = []
            for k, line in enumerate(t.replace(SPACE, " ").split("\n") if t else ()):
                rest = line.split(" ")
                head = rest.pop(0) if k else ""  # before a text stands a dummy space
                if head:
                    bare.add(head)
                spaced.update(rest)
                own.append((head, rest))
            cut.append(own)
        spaced.discard("")
        self.learn(spaced, bare)
        words = self.spaced
        out = []
        for own in cut:
            n = max(0, len(own) - 1)  # a line feed is no piece: one byte
            for head, rest in own:
                if head:
                    n += self.bare[head]
                if "" not in rest:
                    n += sum(map(words.__getitem__, rest))
                    continue
                spaces = 0
                for w in rest:
                    spaces += 1
                    if w:
                        n += self.run(spaces) + words[w] - 1 if w in self.alone else self.run(spaces - 1) + words[w]
                        spaces = 0
                n += self.run(spaces)
            out.append(n)
        return out


@lru_cache(maxsize=2)
def merger(path: str, remembered: int) -> PieceMerger:
    """One for each Python worker, over all its tasks."""
    return PieceMerger(path, remembered)


def model_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, remembered: int = 1_000_000) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    n_tokens is what the model's own library gives without begin, end or added special tokens. A null
    or empty text has no bytes and no tokens; repeated rows give repeated results; an empty table gives
    an empty result; other columns are ignored. ``remembered`` bounds the pre-tokens that a worker keeps.
    """

    def counts(batches):
        own = merger(model_path(model), remembered)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column("text").to_pylist()
                n = own.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(counts, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
