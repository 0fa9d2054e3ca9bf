"""A linear-chain conditional random field over the words of a text.

A word's score for each label is the sum of the weights of its features: byte n-grams of the
word between boundary marks (the ones at a mark are its affixes), the word itself, and its
entry in a lexicon of words that occur almost only under one label.  Features are hashed into
one table.  Learned transitions join neighbouring words; forward-backward gives each word's
label marginals.  A chain is a run of at most ``CHAIN`` words of one text; every word of a text
lies in one.

Everything runs over a block of texts at once: features and scores once for each distinct
word, forward-backward over all chains of the block in step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Words, mix

#: Words of a chain.
CHAIN = 64
#: Rows of the weight table (a power of two).
ROWS = 1 << 17
ORDERS = (2, 3, 4, 5)

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


class Block:
    """The words of some texts, their distinct ones' features, and the chains."""

    def __init__(self, texts: pa.Array):
        w = Words(pc.utf8_lower(texts), LETTER, lower=False)
        self.words = w
        self.n = len(w.start)
        self.key, first, self.word = np.unique(w.key, return_index=True, return_inverse=True)
        start, end = w.start[first], w.end[first]
        length = end - start
        # the distinct words end to end, each between two zero bytes
        size = length + 2
        begin = np.cumsum(size) - size
        text = np.zeros(int(size.sum()), np.uint64)
        owner = np.repeat(np.arange(len(start)), size)
        inner = np.arange(len(text)) - begin[owner]
        body = (inner > 0) & (inner <= length[owner])
        text[body] = w.data[(start[owner] + inner - 1)[body]].astype(np.uint64) + np.uint64(1)
        left = size[owner] - inner  # bytes from here to the word's end
        code, ids, own = np.zeros(len(text), np.uint64), [(mix(self.key) >> np.uint64(20)) % np.uint64(ROWS)], [np.arange(len(start))]
        for k in range(max(ORDERS)):
            code[:len(text) - k] = code[:len(text) - k] * np.uint64(263) + text[k:]
            if k + 1 in ORDERS:
                fits = left > k
                ids.append((mix(code[fits] + np.uint64(k << 56)) >> np.uint64(20)) % np.uint64(ROWS))
                own.append(owner[fits])
        own = np.concatenate(own)
        by = np.argsort(own, kind="stable")
        self.feature = np.concatenate(ids)[by].astype(np.int32)
        self.owner = own[by]
        self.from_ = np.searchsorted(self.owner, np.arange(len(start)))
        # chains: runs of CHAIN words within each text
        runs = -(-w.count // CHAIN)
        doc = np.repeat(np.arange(len(runs)), runs)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
        at = w.first[doc] + turn * CHAIN
        own_length = np.minimum(CHAIN, w.first[doc] + w.count[doc] - at)
        by = np.argsort(-own_length, kind="stable")
        self.at, self.length = at[by], own_length[by]

    def parts(self, most: int):
        """The block in pieces of whole chains with at most about ``most`` words: each as the
        range of its words and a block of its own (without texts)."""
        if self.n <= max(most, CHAIN):
            if self.n:
                yield slice(0, self.n), self
            return
        by = np.argsort(self.at)
        at, length = self.at[by], self.length[by]
        size = np.diff(np.append(self.from_, len(self.feature)))
        chain = 0
        while chain < len(at):
            upto = max(chain + 1, int(np.searchsorted(at + length, at[chain] + max(most, CHAIN), side="right")))
            low, high = int(at[chain]), int(at[upto - 1] + length[upto - 1])
            part = object.__new__(Block)
            part.n = high - low
            used, part.word = np.unique(self.word[low:high], return_inverse=True)
            part.key, n = self.key[used], size[used]
            part.from_ = np.cumsum(n) - n
            part.feature = self.feature[np.repeat(self.from_[used] - part.from_, n) + np.arange(int(n.sum()))]
            part.owner = np.repeat(np.arange(len(used)), n)
            order = np.argsort(-length[chain:upto], kind="stable")
            part.at, part.length = at[chain:upto][order] - low, length[chain:upto][order]
            yield slice(low, high), part
            chain = upto


class Crf:
    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.rows = ROWS  # of the weight table, which keeps its size where there are many labels
        while self.rows * k > ROWS * 200 and self.rows > 1 << 10:
            self.rows //= 2
        self.weight = np.zeros((self.rows, k), np.float32)
        self.lexicon = np.zeros(0, np.uint64)  # sorted keys of words, and the label of each
        self.lexicon_label = np.zeros(0, np.int64)
        self.lexicon_weight = np.zeros((k, k), np.float32)
        self.bias = np.zeros(k, np.float32)
        self.step = np.zeros((k, k), np.float32)

    def listed(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Which distinct words are in the lexicon, and under which label."""
        if not len(self.lexicon):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, block.key), len(self.lexicon) - 1)
        hit = np.flatnonzero(self.lexicon[at] == block.key)
        return hit, self.lexicon_label[at[hit]]

    def scores(self, block: Block) -> np.ndarray:
        """Label scores of each distinct word."""
        out = np.add.reduceat(self.weight[block.feature & (self.rows - 1)], block.from_, axis=0) + self.bias
        hit, label = self.listed(block)
        out[hit] += self.lexicon_weight[label]
        return out

    def marginals(self, block: Block) -> np.ndarray:
        """Label probabilities of each word."""
        if not block.n:
            return np.zeros((0, len(self.labels)), np.float32)
        return self._chains(block, self.scores(block))[0]

    def _chains(self, block: Block, scores: np.ndarray, pairs: bool = False):
        psi = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
        across = np.exp(self.step - self.step.max())
        k = len(self.labels)
        ahead = np.empty((block.n, k), np.float32)
        at, length = block.at, block.length
        longest = int(length[0])
        alive = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")  # chains of more than t words
        a = np.full((len(at), k), 1.0 / k, np.float32)
        for t in range(longest):
            n = alive[t]
            now = at[:n] + t
            a = (a[:n] @ across if t else a[:n]) * psi[block.word[now]]
            a /= a.sum(axis=1, keepdims=True)
            ahead[now] = a
        joint = np.zeros((k, k))
        b = np.ones((len(at), k), np.float32)
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            now = at[:n] + t
            back = b[:n] * psi[block.word[now]]
            if pairs and t:
                before = ahead[now - 1]
                norm = np.einsum("ni,ni->n", before @ across, back)
                joint += across * (before.T @ (back / norm[:, None]))
            g = ahead[now] * b[:n]
            ahead[now] = g / g.sum(axis=1, keepdims=True)
            back = back @ across.T
            b[:n] = back / back.sum(axis=1, keepdims=True)
        return ahead, joint

    def learn(self, blocks: list[tuple[Block, np.ndarray]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-6) -> None:
        """Fit to blocks of words with labels by stochastic gradient (AdaGrad) on the
        conditional log-likelihood."""
        k = len(self.labels)
        seen = [np.full_like(x, 1e-3) for x in (self.weight, self.lexicon_weight, self.bias, self.step)]
        for _ in range(rounds):
            for block, label in blocks:
                if not block.n:
                    continue
                got, joint = self._chains(block, self.scores(block), pairs=True)
                got[np.arange(block.n), label] -= 1  # expected less observed
                by_word = np.stack([np.bincount(block.word, weights=got[:, j], minlength=len(block.key)) for j in range(k)], axis=1) / block.n
                weight = np.stack([np.bincount(block.feature & (self.rows - 1), weights=by_word[block.owner, j], minlength=self.rows) for j in range(k)], axis=1)
                hit, own = self.listed(block)
                lexicon = np.zeros_like(self.lexicon_weight)
                np.add.at(lexicon, own, by_word[hit])
                inside = np.ones(block.n, dtype=bool)
                inside[block.at] = False
                follows = np.flatnonzero(inside)
                observed = np.bincount(label[follows - 1] * k + label[follows], minlength=k * k).reshape(k, k)
                step = (joint - observed) / block.n
                for x, g, s in zip((self.weight, self.lexicon_weight, self.bias, self.step), (weight, lexicon, by_word.sum(axis=0), step), seen, strict=True):
                    g = (g + decay * x).astype(np.float32)
                    s += g * g * block.n  # per word, whatever the block's size
                    x -= rate * g * np.sqrt(block.n) / np.sqrt(s)

    def list_words(self, blocks: list[tuple[Block, np.ndarray]], least: int = 5, share: float = 0.95) -> None:
        """The lexicon: words that occur at least so often, and so nearly always under one label."""
        k = len(self.labels)
        keys = np.unique(np.concatenate([b.key for b, _ in blocks]))
        count = np.zeros((len(keys), k))
        for b, label in blocks:
            own = np.searchsorted(keys, b.key)
            count += np.bincount(own[b.word] * k + label, minlength=len(keys) * k).reshape(-1, k)
        total = count.sum(axis=1)
        keep = (total >= least) & (count.max(axis=1) >= share * total)
        self.lexicon, self.lexicon_label = keys[keep], count[keep].argmax(axis=1)
        self.lexicon_weight = np.zeros((k, k), np.float32)
