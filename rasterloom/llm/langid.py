"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .arrowmap import annotate
from .common import BYTE, LOWER, RADIX, RADIX_INV, crc_mod, mix, powers, raw_bytes, word_hashes

#: A public vocabulary; see the parameter `vocabulary`.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of each language, about, from which the piece probabilities are learned.
SAMPLE_DOCS = 1000
#: Bytes of the longest text in that sample.
SAMPLE_BYTES = 1 << 18
#: Bytes of words whose pieces are looked up at once; a longer word is worked through in such steps.
BLOCK = 1 << 18
#: Bytes from which a part is rescaled while it is summed, and after which such a part is cut while learning.
LONG, LEARN_PART = 32, 32
#: Added to each piece's expected count.
SMOOTHING = 0.02


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a sentencepiece vocabulary as lower-case bytes, a word's begin as a blank, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            piece = bytes(LOWER[np.frombuffer(piece, dtype=np.uint8)])
            if piece and b" " not in piece[1:]:  # a blank within occurs in no word
                out.add(piece)
    return sorted(out)


class Lattice:
    """All pieces that occur in a set of words, and sums over the words' segmentations."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        hashes = self._spans(data, at, sizes)
        self.table = {}
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            order = np.argsort(hashes[own])
            seen = np.zeros(1 << 16, dtype=bool)
            seen[(hashes[own] & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.table[size] = (hashes[own][order], own[order], seen)

    @staticmethod
    def _sums(data: np.ndarray) -> np.ndarray:
        return np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * powers(RADIX, len(data)), dtype=np.uint64)])

    def _spans(self, data, at, size, sums=None):
        sums = self._sums(data) if sums is None else sums
        return mix((sums[at + size] - sums[at]) * powers(RADIX_INV, len(data) + 1)[at])

    def arcs(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[int, np.ndarray]:
        """By piece length: for each byte, the piece that begins there within its word, or n."""
        sums, inverse = self._sums(data), powers(RADIX_INV, len(data) + 1)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(data))
        out = {}
        for size, (known, own, seen) in self.table.items():
            at = np.flatnonzero(left >= size)
            if not len(at):
                continue
            h = mix((sums[at + size] - sums[at]) * inverse[at])
            maybe = seen[(h & np.uint64(0xFFFF)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[place] == h
            if not hit.any():
                continue
            arc = np.full(len(data), self.n, dtype=np.int32)
            arc[at[hit]] = own[place[hit]]
            out[size] = arc
        return out

    def parts(self, starts, sizes, arcs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, word) of the words' parts: cut wherever no piece lies across, as all segmentations are there."""
        n = int(sizes.sum())
        change = np.zeros(n + 1, dtype=np.int32)
        for size, arc in arcs.items():
            if size > 1:
                at = np.flatnonzero(arc < self.n)
                change[at + 1] += 1
                change[at + size] -= 1
        free = np.cumsum(change)[:n] == 0
        free[starts] = True
        at = np.flatnonzero(free)
        return at, np.diff(np.append(at, n)), np.searchsorted(starts, at, side="right") - 1

    def forward(self, p: np.ndarray, starts, sizes, arcs, logs: np.ndarray | None = None) -> np.ndarray:
        """Sum over the segmentations of the first t bytes of each part, at start + t (+ the part's number); p: pieces x languages, 0 in the last row.

        With logs (parts x languages), the sums within parts of over LONG bytes are divided by their last value every few bytes,
        and the logarithms of the divisors are added there; without, they are as they are.
        """
        number = np.arange(len(starts))
        base = starts + number
        total = np.zeros((int(sizes.sum()) + len(starts), p.shape[1]))
        total[base] = 1
        reach = max(arcs, default=1)
        order = np.argsort(-sizes, kind="stable")  # the longest first: those that go on are a prefix
        starts, base = starts[order], base[order]
        going = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        many = int((sizes > LONG).sum())
        for t, k in enumerate(going.tolist(), 1):
            s, b = starts[:k], base[:k]
            here = np.zeros((k, p.shape[1]))
            for size, arc in arcs.items():
                if size <= t:
                    piece = arc[s + t - size]
                    on = np.flatnonzero(piece < self.n)
                    if len(on):
                        here[on] += total[b[on] + t - size] * p[piece[on]]
            total[b + t] = here
            if logs is not None and many and t % 4 == 0:
                some = b[: min(k, many)]
                by = total[some + t].copy()
                logs[order[: len(some)]] += np.log(by)
                for d in range(min(reach, t) + 1):
                    total[some + t - d] /= by
        return total

    def expected(self, p: np.ndarray, counts, starts, sizes, arcs) -> np.ndarray:
        """Expected count of each piece over the words, weighted by counts (one language)."""
        alpha = self.forward(p, starts, sizes, arcs)[:, 0]
        base = starts + np.arange(len(starts))
        beta = np.zeros_like(alpha)
        beta[base + sizes] = 1
        longest = int(sizes.max(initial=0))
        for r in range(1, longest + 1):
            live = sizes >= r
            s, b, n = starts[live], base[live], sizes[live]
            here = np.zeros(len(s))
            for size, arc in arcs.items():
                if size <= r:
                    piece = arc[s + n - r]
                    on = np.flatnonzero(piece < self.n)
                    here[on] += beta[(b + n - r)[on] + size] * p[piece[on], 0]
            beta[b + n - r] = here
        weight = counts / alpha[base + sizes]
        word = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(word)) + word
        out = np.zeros(self.n + 1)
        for size, arc in arcs.items():
            on = np.flatnonzero(arc < self.n)
            out += np.bincount(arc[on], alpha[place[on]] * beta[place[on] + size] * p[arc[on], 0] * weight[word[on]], minlength=self.n + 1)
        return out[: self.n]


def lay_out(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as lower-case bytes, each behind a blank: (bytes, starts, sizes)."""
    sizes = stops - starts + 1
    total = int(sizes.sum())
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    offset = np.arange(total) - np.repeat(begin, sizes)
    source = np.repeat(starts, sizes) + offset - 1
    return np.where(offset == 0, np.uint8(0x20), LOWER[data[np.maximum(source, 0)]]) if total else np.zeros(0, np.uint8), begin, sizes


class LanguageModel:
    """Piece probabilities of each language; score(column) gives the log likelihood of each text."""

    def __init__(self, pieces: list[bytes], langs: list[str], p: np.ndarray):
        self.pieces, self.langs, self.p = pieces, langs, p
        self._lattice = None

    def __getstate__(self):
        return self.__dict__ | {"_lattice": None}

    @property
    def lattice(self) -> Lattice:
        if self._lattice is None:
            self._lattice = Lattice(self.pieces)
        return self._lattice

    def word_scores(self, data, starts, stops) -> np.ndarray:
        """Log probability of each word in each language, summed over all its segmentations."""
        out = np.zeros((len(starts), len(self.langs)))
        ends = np.cumsum(stops - starts + 1)
        i = 0
        while i < len(starts):  # blocks bound the lattice's memory
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, side="right")))
            if stops[i] - starts[i] >= BLOCK:
                out[i] = self._long(lay_out(data, starts[i : i + 1], stops[i : i + 1])[0])
                j = i + 1
            else:
                text, at, sizes = lay_out(data, starts[i:j], stops[i:j])
                arcs = self.lattice.arcs(text, at, sizes)
                at, sizes, word = self.lattice.parts(at, sizes, arcs)
                logs = np.zeros((len(at), len(self.langs)))
                total = self.lattice.forward(self.p, at, sizes, arcs, logs)[at + np.arange(len(at)) + sizes]
                np.add.at(out, i + word, logs + np.log(total))
            i = j
        return out

    def _long(self, text: np.ndarray) -> np.ndarray:
        """One word of any length, step by step: the sums of the last bytes are carried from block to block."""
        lattice = self.lattice
        reach = max(lattice.table)
        last, done = [np.ones(len(self.langs))], np.zeros(len(self.langs))  # last[-d]: the sum d - 1 bytes ago
        for a in range(0, len(text), BLOCK):
            from_ = max(0, a - reach)
            part = text[from_ : a + BLOCK]
            arcs = lattice.arcs(part, np.zeros(1, np.int64), np.array([len(part)]))
            for t in range(a - from_ + 1, len(part) + 1):
                here = np.zeros(len(self.langs))
                for size, arc in arcs.items():
                    if size <= min(t, len(last)) and arc[t - size] < lattice.n:
                        here += last[-size] * self.p[arc[t - size]]
                last = [*last[-reach:], here]
                if t % 4 == 0:
                    done += np.log(here)
                    last = [x / here for x in last]
        return done + np.log(last[-1])

    def score(self, column) -> np.ndarray:
        data, ends = raw_bytes(column)
        hashes, starts, stops, first = word_hashes(data, ends)
        out = np.zeros((len(ends) - 1, len(self.langs)))
        if not len(hashes):
            return out
        _, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        scores = self.word_scores(data, starts[one], stops[one])[inverse]
        some = first[1:] > first[:-1]
        out[some] = np.add.reduceat(scores, first[:-1][some], axis=0)
        return out


def learn(counts: dict[str, dict[bytes, int]], pieces: list[bytes], rounds: int = 3) -> LanguageModel:
    """Expectation maximisation from word counts by language, from equal probabilities for pieces of equal length."""
    langs = sorted(counts)
    lattice = Lattice(pieces)
    p = np.zeros((len(pieces) + 1, len(langs)))
    for k, lang in enumerate(langs):
        words = list(counts[lang])
        n = np.array([counts[lang][w] for w in words], dtype=float)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        stops = np.cumsum(sizes)
        text, at, size = lay_out(data, stops - sizes, stops)
        arcs = lattice.arcs(text, at, size)
        at, size, word = lattice.parts(at, size, arcs)
        over = -(-size // LEARN_PART)
        nth = np.arange(int(over.sum())) - np.repeat(np.cumsum(over) - over, over)
        at, size, word = np.repeat(at, over) + nth * LEARN_PART, np.minimum(LEARN_PART, np.repeat(size, over) - nth * LEARN_PART), np.repeat(word, over)
        arcs = lattice.arcs(text, at, size)
        own = np.full((len(pieces) + 1, 1), 1.0 / len(pieces))
        own[-1] = 0
        for _ in range(rounds):
            got = lattice.expected(own, n[word], at, size, arcs) + SMOOTHING
            own[:-1, 0] = got / got.sum()
        p[:, k] = own[:, 0]
    return LanguageModel(pieces, langs, p)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """Learn from about sample_docs rows of each language, none over sample_bytes, chosen by a hash of the text; rows without a language or text count not.

    What comes to the driver is a count for each language (their number is taken to be small) and the word counts of the
    bounded sample.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not sizes:
        return LanguageModel(load_pieces(vocabulary), [], np.zeros((1, 0)))
    rate = F.coalesce(*[F.when(F.col(lang) == k, F.lit(int(min(1.0, sample_docs / n) * 1_000_000))) for k, n in sizes.items()])
    sample = rows.filter(F.octet_length(text) <= sample_bytes).filter(F.pmod(F.xxhash64(text, F.lit(41)), F.lit(1_000_000)) < rate)
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = sample.select(F.col(lang).alias("lang"), F.explode(F.split(low, "[\\x20\\x09-\\x0D]+")).alias("word")).filter("word <> ''")
    counts: dict[str, dict[bytes, int]] = {k: {} for k in sizes}
    for r in words.groupBy("lang", "word").count().toLocalIterator():
        counts[r["lang"]][r["word"].encode()] = r["count"]
    return learn({k: v for k, v in counts.items() if v}, load_pieces(vocabulary))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score, the posterior probability of that language (all equally likely before).

    Texts are read whole: words are white-space separated and lower-cased (A-Z), and a word's probability is the sum
    over all its segmentations into pieces. `und`, score 0: null texts and those without a letter, and all if nothing
    was learned. Ties go to the first language by name. Words of any length are segmented whole. Repeated rows are judged
    alike; an empty table gives an empty result. Columns of those names are replaced, others come back as they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary's size times the languages'

    def make():
        import regex

        model, letter = sent.value, regex.compile(r"\p{L}")

        def apply(column):
            texts = column.to_pylist()
            n = len(texts)
            known = [t is not None and letter.search(t) is not None for t in texts]
            if not model.langs:
                return [["und"] * n, [0.0] * n]
            scores = model.score(column)
            best = scores.argmax(axis=1)
            weight = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
            return [[model.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], [float(w) if k else 0.0 for w, k in zip(weight, known, strict=True)]]

        return apply

    return annotate(docs, text, [StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())], make)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit(docs.filter(~held_out).select("text", "lang"))
    out = predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
