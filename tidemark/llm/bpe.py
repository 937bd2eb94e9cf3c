"""BPE encoding and decoding by per-prefix dynamic programming.

Every prefix of a word has exactly one token that can end its encoding: the token t that is a suffix of the
prefix, is reachable by its own merges, and is pair-compatible with the last token of what precedes it.
Suffix matches come from an Aho-Corasick automaton over the vocabulary; two tokens are compatible when no
merge across their border is due before the merges that build them. Storing that one token for every prefix
and following the back-pointers from the full word gives the ids that rank-ordered merging gives.

Texts may be null (encoded as the empty text), empty or very long; each is encoded whole. Words are cached in
a bounded table in each Python worker; state never depends on other rows. Extra columns pass through; the
output column must not clash with an existing one (ValueError).
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, keep_one

PIECES, WORDS = 200_000, 60_000  # runs and words kept by a worker; then the table starts anew
LONGEST = 128  # characters of those that are kept
PAIRS = 250_000  # pair verdicts kept by a worker
END = ""  # stands for the end of a word inside the automaton
INF = 1 << 60


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(keep) else chr(next(spare)) for b in range(256)]


class PrefixBPE:
    """Encoder for a byte-level BPE vocabulary with word ends, read from the JSON text of its file."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        j = json.loads(spec)
        model = j["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not self.suffix or model.get("continuing_subword_prefix"):
            raise ValueError("needs a BPE vocabulary with an end-of-word suffix")
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.added = {a["content"]: a["id"] for a in j.get("added_tokens", ())}
        self.names |= {i: t for t, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pattern = next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.blank = regex.compile(r"\s+").split
        self.odd_blank = regex.compile("[\x1c-\x1f]").search
        self.chars = _byte_chars()
        # merges: (left id, right id) -> rank; and for each token the pair that makes it
        self.rank: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ", 1)
            x, y, z = self.vocab[a], self.vocab[b], self.vocab.get(a + b)
            self.rank[x << 20 | y] = r
            if z is not None:
                self.made.setdefault(z, (x, y, r))
        self.left_edges: dict[int, list[tuple[int, int]]] = {}
        self.right_edges: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        n = len(self.suffix)
        for t, i in self.vocab.items():
            shown = t[:-n] + END if t.endswith(self.suffix) and len(t) > n else t
            if self._reachable(i, t):
                self.automaton.add_word(shown, (i, len(shown)))
        self.automaton.make_automaton()
        self.word_ids: dict[str, bytes] = {}
        self.piece_ids: dict[str, bytes] = {}

    def _reachable(self, i: int, token: str) -> bool:
        """A token takes part if it is one symbol, or a merge whose two halves may stand side by side until then."""
        if i in self.made:
            x, y, r = self.made[i]
            return self._meets(x, y, r)
        n = len(self.suffix)
        return len(token) == 1 or token.endswith(self.suffix) and len(token) == n + 1

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one border of a token while it is built: (piece, rank of the merge that takes it in), smallest first."""
        known = self.right_edges if side else self.left_edges
        if (edge := known.get(token)) is None:
            edge, t, until = [], token, INF
            while True:
                edge.append((t, until))
                if t not in self.made:
                    break
                until, t = self.made[t][2], self.made[t][side]
            edge.reverse()
            known[token] = edge
        return edge

    def _meets(self, a: int, b: int, allowed: int) -> bool:
        """No merge across the border of a and b comes before the merges inside them; one of rank ``allowed`` on the whole tokens may."""
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        rank = self.rank.get
        while True:
            x, x_until = left[i]
            y, y_until = right[j]
            r = rank(x << 20 | y, INF)
            # of equal ranks the leftmost goes first: the left token's own merge before, the right token's after
            if r < x_until and r <= y_until and r != INF:
                return r == allowed and x == a and y == b
            if x_until == INF and y_until == INF:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._meets(a, b, -1)
        return ok

    def encode_word(self, word: str) -> bytes:
        """Ids of one word in byte characters, without its end mark."""
        whole = word + END
        size = len(whole)
        last: list = [None] * (size + 1)  # for each prefix: its last token and where that begins
        last[0] = (-1, 0)
        pairs, compatible = self.pairs, self.compatible
        for end, (t, n) in self.automaton.iter(whole):
            end += 1
            if last[end] is not None:
                continue
            before = last[end - n]
            if before is None:
                continue
            p = before[0]
            if p < 0 or (ok := pairs.get(p << 20 | t)) or ok is None and compatible(p, t):
                last[end] = (t, end - n)
        ids, at = [], size
        while at:
            t, at = last[at]
            ids.append(t)
        ids.reverse()
        return array("I", ids).tobytes()

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a run without white space."""
        out, known, chars = [], self.word_ids, self.chars
        for w in self.words(piece):
            if (ids := known.get(w)) is None:
                ids = self.encode_word("".join([chars[b] for b in w.encode()]) if not (w.isascii() and w.isprintable()) else w)
                if len(known) >= WORDS:
                    known.clear()
                if len(w) <= LONGEST:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        pieces = self.blank(text.lower()) if self.odd_blank(text) else text.lower().split()
        known = self.piece_ids
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            out = []
            for p in pieces:
                if (ids := known.get(p)) is None:
                    ids = self.encode_piece(p)
                    if len(known) >= PIECES:
                        known.clear()
                    if len(p) <= LONGEST:
                        known[p] = ids
                out.append(ids)
            return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        if self.split_added is None or not any(a in text for a in self.added):
            return self._plain(text)
        return b"".join(array("I", [self.added[s]]).tobytes() if s in self.added else self._plain(s) for s in self.split_added.split(text))

    def decode(self, packed: bytes) -> str:
        """The tokens' strings joined by spaces, as for a vocabulary file without a decoder."""
        return " ".join(map(self.names.__getitem__, array("I", packed)))


def encoder(spec: str) -> PrefixBPE:
    """The worker's encoder for a vocabulary; built once for tasks that follow each other."""
    return keep_one(("bpe", zlib.crc32(spec.encode())), lambda: PrefixBPE(spec))


def _spec(df: DataFrame, vocabulary: str):
    """The vocabulary file's text as a broadcast: read once on the driver, bounded by the vocabulary, not by the data."""
    with open(vocabulary, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` and its ``text`` as token ids: binary, little-endian unsigned 32-bit integers; null text gives none (empty binary)."""
    spec = _spec(df, vocabulary)

    def start():
        enc = encoder(spec.value)
        return lambda texts: [[enc.encode(t or "") for t in texts]]

    return add_columns(df, [text], {out: "binary"}, start)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` and the text of its packed ``ids``; null ids give the empty text."""
    spec = _spec(df, vocabulary)

    def start():
        enc = encoder(spec.value)
        return lambda packed: [[enc.decode(b or b"") for b in packed]]

    return add_columns(df, [ids], {out: "string"}, start)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """encode() and decode() in one pass of the same workers: ``keep`` with ids and decoded."""
    spec = _spec(df, vocabulary)

    def start():
        enc = encoder(spec.value)

        def both(texts):
            ids = [enc.encode(t or "") for t in texts]
            return [ids, [enc.decode(b) for b in ids]]

        return both

    return add_columns(df, [text], {"ids": "binary", "decoded": "string"}, start, keep)


def digests(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256 of the round trip."""
    return round_trip(df, vocabulary, text, [key]).select(
        F.col(key),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
