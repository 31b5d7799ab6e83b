"""Token counts (operator 10): heap-and-linked-list byte-pair merging, no identifiers emitted.

The number of tokens of a unit is its initial symbols minus the merges made: the pair of lowest
rank is popped from a heap, its halves are spliced in a linked list, and the two pairs that the
splice creates are pushed. Texts are cut before each run of word marks, where no piece of the
vocabulary can cross, so each distinct unit is merged once per task (a bounded memo).

Defined cases: null or empty text has 0 tokens and 0 bytes; a text of spaces only is one run of
word marks; a repeated row is counted again; an empty table gives an empty result; columns of the
input other than id and text are ignored.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, schema, table

MARK = "▁"
#: Units remembered in a task; the memo is emptied when full.
MEMO_UNITS = 400_000
#: Characters of a long text taken at a time; a cut falls only where merging cannot cross.
CUT_CHARS = 1 << 20
OVER_LIMIT = 4096


class PieceCounter:
    """Counts as a sentencepiece byte-pair model with byte fallback and no normalisation does."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(model_file, "rb") as f:
            m.ParseFromString(f.read())
        n, t = m.normalizer_spec, m.trainer_spec
        if t.model_type != t.BPE or n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces and t.byte_fallback):
            raise ValueError("only byte-pair models with byte fallback, a word mark in front and no other normalisation are counted here")
        pieces = [(p.piece, p.score) for p in m.pieces if p.type == p.NORMAL]
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in m.pieces):
            raise ValueError("models with user-defined or unused pieces are not counted here")
        order = sorted(pieces, key=lambda x: -x[1])
        rank = {p: i for i, (p, _) in enumerate(order)}
        levels = {x: i for i, x in enumerate(dict.fromkeys(x for _, x in order))}
        #: Pieces of one score share a level; of these the leftmost pair merges first.
        self.level = [levels[x] for _, x in order]
        if any(MARK in p.lstrip(MARK) for p in rank):
            raise ValueError("a piece crosses a word boundary; texts of such a model cannot be cut")
        #: Symbols are ranks of pieces. Two neighbours' symbols, packed in one integer, give the symbol they merge to.
        self.symbol = {p: r for p, r in rank.items() if len(p) == 1}
        self.pairs = {rank[p[:i]] << 20 | rank[p[i:]]: r for p, r in rank.items() for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank}
        self.memo: dict[str, int] = {}

    def unit(self, s: str) -> int:
        """Tokens of one unit: initial symbols minus merges, and the further bytes of characters without a piece.

        The heap holds ``level << bits | place``, so equal levels pop from left to right. An entry is
        stale, and skipped, if the symbols now at its place no longer merge to its level.
        """
        sym = list(map(self.symbol.get, s))
        n = len(s)
        extra = 0
        if None in sym:
            extra = sum(len(c.encode()) - 1 for c, x in zip(s, sym, strict=True) if x is None)
            sym = [-1 if x is None else x for x in sym]
        pair, level = self.pairs.get, self.level
        bits = n.bit_length()
        heap = [level[r] << bits | i for i in range(n - 1) if (r := pair(sym[i] << 20 | sym[i + 1])) is not None]
        if not heap:
            return n + extra
        heapify(heap)
        low, merges = (1 << bits) - 1, 0
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        sym.append(-1)  # what stands after the end merges with nothing
        while heap:
            e = heappop(heap)
            i = e & low
            j = nxt[i]
            if sym[i] < 0 or (r := pair(sym[i] << 20 | sym[j])) is None or level[r] != e >> bits:
                continue
            merges += 1
            sym[i], sym[j] = r, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (x := pair(r << 20 | sym[k])) is not None:
                    heappush(heap, level[x] << bits | i)
            if (h := prv[i]) >= 0 and (x := pair(sym[h] << 20 | r)) is not None:
                heappush(heap, level[x] << bits | h)
        return n - merges + extra

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, at, n = 0, 0, len(text)
        while at < n:
            end = at + CUT_CHARS
            while end < n and not (text[end] in " ▁" and text[end - 1] not in " ▁"):
                end += 1
            total += self._part(("" if at else MARK) + text[at:end].replace(" ", MARK))
            at = end
        return total

    def _part(self, s: str) -> int:
        units = _UNITS(s)
        memo = self.memo
        if len(memo) > MEMO_UNITS:
            memo.clear()
        for u in set(units).difference(memo):
            memo[u] = self.unit(u)
        return sum(map(memo.__getitem__, units))


#: One counter per model in each Python worker, so the memo outlives a task.
_COUNTERS: dict[str, PieceCounter] = {}
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall


def token_counts(df: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", over_limit: int = OVER_LIMIT) -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit for each row of ``df``. One narrow pass, no shuffle."""

    def make():
        c = _COUNTERS.get(model_file) or _COUNTERS.setdefault(model_file, PieceCounter(model_file))

        def run(texts):
            n = [c.count(t) for t in texts]
            return [[len(t.encode()) if t else 0 for t in texts], n, [x > over_limit for x in n]]

        return run

    return map_texts(df, [id_col], text_col, schema("n_bytes long, n_tokens long, over_limit boolean"), make)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
