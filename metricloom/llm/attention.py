"""A causal self-attention language model in numpy, small enough to score a corpus with.

It predicts the class of the next token from one attention head over a window and the token before; a table then gives
the token in its class, by the token before (rare ones by their class). Both factors are normalised, so their product is
a distribution over tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


@dataclass(frozen=True)
class Attention:
    """end: the token that opens and closes every text. embed: token x width. place: position x width. bilinear: the
    product of query and key projection. out: twice the width x classes. kind: class of each token. before,
    column: of each token, its row and column in ``inside``, log10 p(column | class, token before); alone: log10
    p(token | column), for the rare tokens of a class share one."""

    end: int
    overlap: int
    embed: np.ndarray
    place: np.ndarray
    bilinear: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    kind: np.ndarray
    before: np.ndarray
    column: np.ndarray
    inside: np.ndarray
    alone: np.ndarray

    @property
    def window(self) -> int:
        return len(self.place)

    def log10_class(self, tokens: np.ndarray, kinds: np.ndarray, wanted: np.ndarray, skip: int = 0) -> np.ndarray:
        """log10 p(class of the next token) at the ``wanted`` positions of windows, given the tokens up to there.

        The first ``skip`` positions are only read: ``kinds`` and ``wanted`` begin behind them.
        """
        x = with_ones(np.take(self.embed, tokens, axis=0), self.place)
        _, weight, _ = attended(x, self.bilinear, skip)
        sums = np.matmul(weight, x)
        both = np.empty((*sums.shape[:2], 2 * x.shape[2] - 1), dtype=np.float32)
        both[:, :, :x.shape[2] - 1] = x[:, skip:, :-1]
        np.divide(sums, sums[:, :, -1:], out=both[:, :, x.shape[2] - 1:])
        both, kinds = both.reshape(-1, both.shape[2]), kinds.ravel()
        if not wanted.all():
            where = np.flatnonzero(wanted)
            both, kinds = both[where], kinds[where]
        logits = both @ np.vstack([self.out, self.bias])
        best = np.minimum(logits.ravel()[np.arange(0, logits.size, logits.shape[1]) + kinds], 60)
        exp_below(logits, 60)
        total = logits @ np.ones(logits.shape[1], dtype=np.float32)
        return (best - np.log(total)) * np.float32(1 / np.log(10))

    def log10_inside(self, tokens: np.ndarray, following: np.ndarray) -> np.ndarray:
        """log10 p(following | its class, the token before)."""
        return self.inside[self.before[tokens], self.column[following]] + self.alone[following]

    def log10_next(self, tokens: np.ndarray, following: np.ndarray) -> np.ndarray:
        """log10 p(following) at each position of each window, given the tokens up to there."""
        value = self.log10_class(tokens, self.kind[following], np.ones(tokens.shape, dtype=bool))
        return value.reshape(tokens.shape) + self.log10_inside(tokens, following)

    def score(self, texts: list[np.ndarray], block: int = 64) -> np.ndarray:
        """log10 probability of each text (its tokens, then the end). Windows overlap; each token counts once."""
        parts, bounds = [], [0]
        for t in texts:
            parts += [[self.end], t, [self.end]]
            bounds.append(bounds[-1] + len(t) + 2)
        flat = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
        stride = self.window - self.overlap
        bounds = np.array(bounds)
        steps = np.diff(bounds) - 1  # predictions of each text
        counts = 1 + np.maximum(0, -(-(steps - self.window) // stride))
        owner = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = bounds[:-1][owner] + nth * stride
        stop = bounds[1:][owner] - 1
        padded = np.concatenate([flat, np.full(self.window + 1, self.end)])
        tokens = sliding_window_view(padded, self.window)
        kinds = sliding_window_view(self.kind[padded].astype(np.int64), self.window)
        inside = self.log10_inside(flat[:-1], flat[1:])
        inside[bounds[1:-1] - 1] = 0  # from the end of a text to the next one's begin
        out = np.bincount(np.repeat(np.arange(len(texts)), steps + 1)[:-1], weights=inside, minlength=len(texts))
        # Behind the first window of a text, its overlap is only read.
        for skip, chosen in ((0, np.flatnonzero(nth == 0)), (self.overlap, np.flatnonzero(nth))):
            for at in range(0, len(chosen), block):
                some = chosen[at:at + block]
                fresh = np.arange(skip, self.window) < (stop - start)[some, None]
                value = self.log10_class(tokens[start[some]], kinds[start[some] + 1][:, skip:], fresh, skip)
                own = np.repeat(owner[some], fresh.sum(axis=1))
                first = own[0]  # the owners of a block are neighbours
                sums = np.bincount(own - first, weights=value)
                out[first:first + len(sums)] += sums
        return out


def with_ones(embedded: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Inputs of windows, and a one behind each: what it is weighted with gives the sum of the weights."""
    x = np.empty((*embedded.shape[:2], embedded.shape[2] + 1), dtype=np.float32)
    np.add(embedded, place, out=x[:, :, :-1])
    x[:, :, -1] = 1
    return x


def exp_below(x: np.ndarray, most: float) -> None:
    """exp() in place, of ``most`` at the most; to look for the greatest first is faster than to cut each."""
    if x.size and x.max() > most:
        np.minimum(x, most, out=x)
    np.exp(x, out=x)


def attended(x: np.ndarray, bilinear: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries of the positions from ``skip`` on, their weights of all positions (later ones weigh nothing), and the
    inputs turned: products of many small matrices are several times as fast by a copy that lies in order."""
    query, turned = x[:, skip:, :-1] @ bilinear, x.transpose(0, 2, 1).copy()
    weight = np.matmul(query, turned[:, :-1])
    exp_below(weight, 30)
    weight *= np.tri(x.shape[1], dtype=np.float32)[skip:]
    return query, weight, turned


def token_classes(near, count: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Classes of tokens by what stands before and after them: k-means on square roots of shares.

    near: gives for classes of all tokens a table of how often each class stands before (left half) and after a token.
    """
    ranked = np.argsort(-count, kind="stable")
    kind = np.full(len(count), classes - 1, dtype=np.int32)
    kind[ranked[:classes - 1]] = np.arange(classes - 1)
    seen = np.flatnonzero(count)
    for _ in range(rounds if len(seen) else 0):
        beside = near(kind)[seen].astype(np.float32)
        beside = np.sqrt(beside / np.maximum(beside.sum(axis=1, keepdims=True), 1))
        centre = np.zeros((classes, 2 * classes), dtype=np.float32)
        weight = np.sqrt(count[seen]).astype(np.float32)
        np.add.at(centre, kind[seen], beside * weight[:, None])
        centre /= np.maximum(np.bincount(kind[seen], weights=weight, minlength=classes), 1e-9)[:, None]
        empty = np.flatnonzero(np.bincount(kind[seen], minlength=classes) == 0)[:len(seen)]
        centre[empty] = beside[np.searchsorted(seen, ranked[:len(empty)])]
        kind[seen] = (beside @ centre.T - (centre ** 2).sum(axis=1) / 2).argmax(axis=1)
    return kind


def beside(left: np.ndarray, right: np.ndarray, n: np.ndarray, kind: np.ndarray, classes: int) -> np.ndarray:
    """The table that token_classes() asks for, flat, of counted pairs of neighbours."""
    cells = np.concatenate([right * (2 * classes) + kind[left], left * (2 * classes) + classes + kind[right]])
    return np.bincount(cells, weights=np.concatenate([n, n]), minlength=len(kind) * 2 * classes)


def places(count: np.ndarray, kind: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each token in ``inside``: the most frequent tokens have their own, the others their class's."""
    rank = np.empty(len(kind), dtype=np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(kind))
    return np.where(rank < rows, rank, rows + kind), np.where(rank < columns, rank, columns + kind)


def inside_classes(pair: np.ndarray, count: np.ndarray, kind: np.ndarray, classes: int, rows: int, columns: int,
                   back_off: float) -> dict[str, np.ndarray]:
    """The tables before, column, inside and alone: shares of tokens in their class, by the token before.

    pair: counts of pairs by row and column. They are backed off to the shares without the token before, and these are
    smoothed.
    """
    before, column = places(count, kind, rows, columns)
    width = columns + classes
    of_column = np.zeros(width, dtype=np.int64)
    of_column[column], of_column[columns:] = kind, np.arange(classes)
    mass = np.bincount(column, weights=count + 0.02, minlength=width) + 1e-9
    alone = np.log10((count + 0.02) / mass[column]).astype(np.float32)
    share = mass / np.bincount(of_column, weights=mass, minlength=classes)[of_column]
    for c in range(classes):
        own = of_column == c
        counts = pair[:, own]
        pair[:, own] = np.log10((counts + np.float32(back_off) * share[own].astype(np.float32))
                                / (counts.sum(axis=1, keepdims=True) + np.float32(back_off)))
    return {"before": before, "column": column, "inside": pair, "alone": alone}


def starting(count: np.ndarray, kind: np.ndarray, classes: int, width: int, window: int, seed: int
             ) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    weights = {"embed": random.normal(0, 0.3, (len(kind), width)), "place": np.zeros((window, width)),
               "bilinear": np.eye(width) * 0.3, "out": random.normal(0, 0.3, (2 * width, classes)),
               "bias": np.log(np.bincount(kind, weights=count, minlength=classes) + 1.0)}
    weights = {k: v.astype(np.float32) for k, v in weights.items()}
    weights["bias"] -= weights["bias"].max()
    return weights


def slopes(weights: dict[str, np.ndarray], tokens: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean loss over windows; where ``wanted`` is negative nothing is predicted.

    Weights are not divided by their sums, cell by cell; the sums are divided out of what is gathered by them.
    """
    size, width = weights["embed"].shape
    x = with_ones(np.take(weights["embed"], tokens, axis=0), weights["place"])
    own, rows = x[:, :, :-1], x.reshape(-1, width + 1)[:, :-1]
    query, weight, turned = attended(x, weights["bilinear"])
    gathered = np.matmul(weight, x)
    total = gathered[:, :, -1:].copy()
    both = np.empty((*tokens.shape, 2 * width + 1), dtype=np.float32)
    both[:, :, :width] = own
    np.divide(gathered, total, out=both[:, :, width:])
    gathered, both = both[:, :, width:-1], both.reshape(-1, 2 * width + 1)
    p = both @ np.vstack([weights["out"], weights["bias"]])
    if p.size and p.min() < -60:
        np.maximum(p, -60, out=p)
    exp_below(p, 60)
    valid = wanted.ravel() >= 0
    part = valid.astype(np.float32) / np.float32(max(valid.sum(), 1))
    p *= (part / (p @ np.ones(p.shape[1], dtype=np.float32)))[:, None]
    p.ravel()[np.arange(0, p.size, p.shape[1]) + np.maximum(wanted.ravel(), 0)] -= part
    d_out = both.T @ p
    d_both = (p @ weights["out"].T).reshape(*tokens.shape, 2 * width)
    # Slopes of what is gathered, and behind them what they lose to the sum of the weights.
    pull = np.empty_like(x)
    np.divide(d_both[:, :, width:], total, out=pull[:, :, :-1])
    np.negative(np.einsum("wpi,wpi->wp", pull[:, :, :-1], gathered), out=pull[:, :, -1])
    d_score = np.matmul(pull, turned)
    d_score *= weight
    d_query = np.matmul(d_score, own).reshape(-1, width)
    d_x = (d_query @ weights["bilinear"].T).reshape(own.shape)
    d_x += d_both[:, :, :width]
    d_x += np.matmul(weight.transpose(0, 2, 1), pull[:, :, :-1])
    d_x += np.matmul(d_score.transpose(0, 2, 1), query)
    flat = tokens.ravel().astype(np.uint16 if size <= 1 << 16 else np.int64)
    order = np.argsort(flat, kind="stable")
    sorted_ = flat[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    d_embed = np.zeros((size, width), dtype=np.float32)
    d_embed[sorted_[first]] = np.add.reduceat(np.take(d_x.reshape(-1, width), order, axis=0), first, axis=0)
    return {"embed": d_embed, "place": d_x.sum(axis=0), "bias": d_out[-1], "out": d_out[:-1],
            "bilinear": rows.T @ d_query}


def descend(weights: dict[str, np.ndarray], draws, steps: int, rate: float, begin: float = 0.0, end: float = 1.0
            ) -> dict[str, np.ndarray]:
    """Adam over ``steps`` of the (tokens, wanted) in draws; ``begin`` to ``end`` is the part of the whole training.

    A step costs what its batch holds: of the embedding only the tokens in the batch are looked at and moved.
    """
    weights = {k: v.copy() for k, v in weights.items()}
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    met, number = np.zeros(len(weights["embed"]), dtype=bool), np.zeros(len(weights["embed"]), dtype=np.int64)
    for step, (tokens, wanted) in enumerate(draws, 1):
        met[tokens] = True
        seen = np.flatnonzero(met)
        met[seen], number[seen] = False, np.arange(len(seen))
        slope = slopes({**weights, "embed": np.take(weights["embed"], seen, axis=0)}, number[tokens], wanted)
        now = rate * min(1, step / 20) * (1 - (begin + (end - begin) * step / (steps + 1)))
        for k, g in slope.items():
            at = seen if k == "embed" else slice(None)
            one, two = first[k][at], second[k][at]
            one = one + 0.1 * (g - one)
            two = two + 0.01 * (g * g - two)
            first[k][at], second[k][at] = one, two
            weights[k][at] -= now / (1 - 0.9 ** step) * one / (np.sqrt(two / (1 - 0.99 ** step)) + 1e-8)
    return weights


def train(texts: list[np.ndarray], vocabulary: int, end: int, classes: int = 32, width: int = 12, window: int = 32,
          overlap: int = 8, steps: int = 600, batch: int = 256, rate: float = 0.01, rows: int = 2000, columns: int = 6000,
          back_off: float = 8.0, seed: int = 5) -> Attention:
    """Fit in one process, by Adam on windows drawn from the texts; the gradients are written out."""
    random = np.random.default_rng(seed)
    flow = np.concatenate([np.concatenate([[end], t, [end]]) for t in texts]).astype(np.int64)
    left, right, n = flow[:-1], flow[1:], np.ones(len(flow) - 1)
    count = np.bincount(flow, minlength=vocabulary)
    kind = token_classes(lambda k: beside(left, right, n, k, classes).reshape(vocabulary, -1), count, classes)
    before, column = places(count, kind, rows, columns)
    pair = np.zeros((rows + classes, columns + classes), dtype=np.float32)
    np.add.at(pair, (before[left], column[right]), 1)
    tables = inside_classes(pair, count, kind, classes, rows, columns, back_off)
    flow = np.concatenate([flow, np.full(window + 1, end)])

    def draws():
        for _ in range(steps):
            index = random.integers(0, len(flow) - window - 1, batch)[:, None] + np.arange(window)
            yield flow[index], kind[flow[index + 1]]

    weights = descend(starting(count, kind, classes, width, window, seed), draws(), steps, rate)
    return Attention(end, overlap, kind=kind, **tables, **weights)
