"""A skip-chain conditional random field in NumPy, many texts at a time.

Tokens of a text form a chain; tokens of a text that repeat or resemble each other are
linked by skip edges whose potential favours a common class, with one weight for each
kind of edge. Beliefs come from loopy message passing: the chain is summed exactly,
forward and backward, with the messages of the skip edges added to its nodes, and the
skip messages are renewed from the beliefs without what came over the same edge.

A token is a row of feature numbers; number 0 is a feature without weight. Texts are
handled in batches of at most CELLS padded tokens, so a long text is a batch of its own
and memory follows the tokens, not the number of texts times the longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Padded tokens of a batch when reading, and tokens whose feature weights are gathered at once.
CELLS, GATHER = 1 << 15, 1 << 13


class SkipChainCRF:
    def __init__(self, labels: list[str], classes: list[int], kinds: int = 2, rounds: int = 3):
        self.labels, self.classes, self.rounds = labels, np.array(classes), rounds
        n = len(labels)
        self.weights, self.step = np.zeros((1, n), np.float32), np.zeros((n, n))
        self.first, self.same = np.zeros(n), np.full(kinds, 0.5)
        self.onehot = np.eye(max(classes) + 1)[self.classes]

    # ----- inference

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        out = np.empty((len(ids), len(self.labels)))
        for at in range(0, len(ids), GATHER):
            out[at : at + GATHER] = self.weights[ids[at : at + GATHER]].sum(axis=1)
        return out

    def _chain(self, node: np.ndarray, mask: np.ndarray, pairs: bool = False):
        """Exact marginals of padded chains (texts, length, labels); with pairs also the expected transitions."""
        n, t, k = node.shape
        top = node.max(axis=2, keepdims=True)
        e, step = np.exp(node - top), np.exp(self.step)
        forward = np.zeros_like(e)
        a = e[:, 0] * np.exp(self.first)
        for i in range(t):
            if i:
                a = np.where(mask[:, i, None], (forward[:, i - 1] @ step) * e[:, i], forward[:, i - 1])
            forward[:, i] = a / a.sum(axis=1, keepdims=True)
        backward = np.ones_like(e)
        moves = np.zeros((k, k))
        for i in range(t - 2, -1, -1):
            ahead = backward[:, i + 1] * e[:, i + 1]
            live = mask[:, i + 1, None]
            if pairs:
                both = forward[:, i, :, None] * step[None] * ahead[:, None, :] * live[:, :, None]
                moves += (both / np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
            b = np.where(live, ahead @ step.T, backward[:, i + 1])
            backward[:, i] = b / b.sum(axis=1, keepdims=True)
        belief = forward * backward
        return belief / belief.sum(axis=2, keepdims=True), moves

    def beliefs(self, node: np.ndarray, mask: np.ndarray, edges: np.ndarray, pairs: bool = False):
        """(marginals, expected transitions, node potentials with skip messages, P(same class) per edge); edges are (text, left, right, kind)."""
        if not len(edges):
            belief, moves = self._chain(node, mask, pairs)
            return belief, moves, node, np.zeros(0)
        doc, left, right, kind = edges.T
        gain = (np.exp(self.same) - 1)[kind]
        there, back = np.zeros((len(edges), node.shape[2])), np.zeros((len(edges), node.shape[2]))
        agree = np.zeros(len(edges))
        for r in range(self.rounds + 1):
            full = node.copy()
            np.add.at(full, (doc, right), there)
            np.add.at(full, (doc, left), back)
            belief, moves = self._chain(full, mask, pairs and r == self.rounds)
            own_left, own_right = belief[doc, left] * np.exp(-back), belief[doc, right] * np.exp(-there)
            class_left, class_right = own_left @ self.onehot, own_right @ self.onehot
            class_left /= class_left.sum(axis=1, keepdims=True)
            class_right /= class_right.sum(axis=1, keepdims=True)
            agree = (class_left * class_right).sum(axis=1)
            if r < self.rounds:
                there, back = np.log1p(gain[:, None] * class_left)[:, self.classes], np.log1p(gain[:, None] * class_right)[:, self.classes]
        return belief, moves, full, (1 + gain) * agree / (1 + gain * agree)

    @staticmethod
    def _padded(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.arange(max(1, lengths.max(initial=1)))[None] < lengths[:, None]
        node = np.zeros((*mask.shape, flat.shape[1]))
        node[mask] = flat
        return node, mask

    @staticmethod
    def _links(edges: list[list[tuple[int, int, int]]], some: list[int]) -> np.ndarray:
        return np.array([(n, *e) for n, i in enumerate(some) for e in edges[i]], np.int64).reshape(-1, 4)

    @staticmethod
    def batches(lengths: np.ndarray, most: int = 256) -> Iterator[list[int]]:
        """Indices of texts with tokens, by length, in batches of at most `most` texts and CELLS padded tokens (or one longer text)."""
        batch: list[int] = []
        for i in np.argsort(lengths, kind="stable").tolist():
            if not lengths[i]:
                continue
            if batch and (len(batch) == most or (len(batch) + 1) * lengths[i] > CELLS):
                yield batch
                batch = []
            batch.append(i)
        if batch:
            yield batch

    def decode(self, node_of: list[np.ndarray], edges: list[list[tuple[int, int, int]]]) -> list[list[int]]:
        """The best label sequence of each text (its emissions) under the chain and the final skip messages."""
        out: list[list[int]] = [[] for _ in node_of]
        lengths = np.array([len(n) for n in node_of], np.int64)
        linked = np.array([bool(e) for e in edges], bool)
        # a text without edges has no messages to wait for
        for some in [*self.batches(np.where(linked, lengths, 0)), *self.batches(np.where(linked, 0, lengths))]:
            lengths = np.array([len(node_of[i]) for i in some])
            node, mask = self._padded(np.concatenate([node_of[i] for i in some]), lengths)
            links = self._links(edges, some)
            if len(links):
                node = self.beliefs(node, mask, links)[2]
            best, came = node[:, 0] + self.first, np.zeros(node.shape, np.int8)
            for i in range(1, node.shape[1]):
                options = best[:, :, None] + self.step[None]
                came[:, i] = options.argmax(axis=1)
                best = np.where(mask[:, i, None], options.max(axis=1) + node[:, i], best)
            for n, i in enumerate(some):
                path = [int(best[n].argmax())]
                for j in range(int(lengths[n]) - 1, 0, -1):
                    path.append(int(came[n, j, path[-1]]))
                out[i] = path[::-1]
        return out

    # ----- training

    def fit(self, features: list[np.ndarray], n_features: int, gold: list[list[int]], edges: list[list[tuple[int, int, int]]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-4, seed: int = 5) -> "SkipChainCRF":
        """Stochastic gradient steps (scaled per weight) on the log likelihood; skip beliefs are the loopy ones."""
        k = len(self.labels)
        weights = np.zeros((n_features, k))
        seen, seen_step, seen_first, seen_same = np.full_like(weights, 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6), np.full(len(self.same), 1e-6)
        rng = np.random.default_rng(seed)
        usable = np.array([i for i in range(len(features)) if len(features[i])], np.int64)
        rng.shuffle(usable)
        usable = usable[np.argsort([len(features[i]) // 8 for i in usable], kind="stable")]
        groups = [usable[at : at + 128].tolist() for at in range(0, len(usable), 128)]
        ready = []
        for some in groups:
            ids = np.concatenate([features[i] for i in some])
            used, where = np.unique(ids, return_inverse=True)
            ready.append((some, used, where.reshape(ids.shape)))
        for _ in range(epochs):
            for b in rng.permutation(len(ready)):
                some, used, where = ready[b]
                lengths = np.array([len(features[i]) for i in some])
                node, mask = self._padded(weights[used][where].sum(axis=1), lengths)
                links = self._links(edges, some)
                belief, moves, _, agree = self.beliefs(node, mask, links, pairs=True)
                truth = np.concatenate([gold[i] for i in some])
                wrong = -belief[mask]
                wrong[np.arange(len(truth)), truth] += 1
                token = np.repeat(np.arange(len(truth)), where.shape[1])
                g = np.stack([np.bincount(where.ravel(), wrong[token, j], len(used)) for j in range(k)], axis=1) - l2 * len(some) * weights[used]
                g[used == 0] = 0
                seen[used] += g * g
                weights[used] += rate * g / np.sqrt(seen[used])
                observed, opening = np.zeros((k, k)), np.zeros(k)
                for i in some:
                    y = np.asarray(gold[i])
                    np.add.at(observed, (y[:-1], y[1:]), 1)
                    opening[y[0]] += 1
                g = observed - moves - l2 * len(some) * self.step
                seen_step += g * g
                self.step += rate * g / np.sqrt(seen_step)
                g = opening - belief[:, 0].sum(axis=0)
                seen_first += g * g
                self.first += rate * g / np.sqrt(seen_first)
                if len(links):
                    same = np.array([float(self.classes[gold[some[n]][a]] == self.classes[gold[some[n]][c]]) for n, a, c, _ in links])
                    g = np.bincount(links[:, 3], same - agree, len(self.same))
                    seen_same += g * g
                    self.same = np.clip(self.same + rate * g / np.sqrt(seen_same), 0.0, 3.0)
        self.weights = weights.astype(np.float32)
        return self
