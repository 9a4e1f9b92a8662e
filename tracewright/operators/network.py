"""A bidirectional recurrent network over windows of coded records, in numpy: loss, gradients, predictions.

Each feature of a record has a code; the vectors of its codes are added up. A long short-term memory reads a window from both
ends, and at every place of it a softmax for each part of a label tells the part's class. All weights stand in one flat array.

Networks of one shape are passed through together, one flat array a row. Arrays end with the windows, so that gates, classes and
places are contiguous; all is reckoned in the type of the weights. What a network gets doesn't depend on those beside it.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np


@dataclass(frozen=True)
class Shape:
    """features: codes of a record, each below buckets; width: records of a window; parts: classes to tell at each place; focus: how much surely right places count less (focal cross entropy; 0: plain)."""

    features: int
    width: int
    buckets: int = 64
    embed: int = 16
    hidden: int = 16
    parts: int = 5
    classes: int = 59
    dropout: float = 0.0
    focus: float = 0.0

    def arrays(self) -> dict[str, tuple[int, ...]]:
        one = {"x": (self.embed, 4 * self.hidden), "h": (self.hidden, 4 * self.hidden), "b": (4 * self.hidden,)}
        return {"codes": (self.features * self.buckets, self.embed), **{f"{d}{k}": s for d in ("on", "back") for k, s in one.items()}, "out": (2 * self.hidden, self.parts * self.classes), "bias": (self.parts * self.classes,)}

    def size(self) -> int:
        return sum(map(prod, self.arrays().values()))

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of the flat array, or of rows of them, by name."""
        out, at = {}, 0
        for name, shape in self.arrays().items():
            out[name] = flat[..., at : at + prod(shape)].reshape(*flat.shape[:-1], *shape)
            at += prod(shape)
        return out

    def start(self, seed: int) -> np.ndarray:
        rng, flat = np.random.default_rng(seed), np.zeros(self.size())
        for name, w in self.split(flat).items():
            if w.ndim == 2:
                w[:] = rng.normal(0, 1 if name == "codes" else 1 / np.sqrt(w.shape[0]), w.shape)
            elif name != "bias":
                w[self.hidden : 2 * self.hidden] = 1.0  # forget little at first
        return flat


def windows_of(shape: Shape, starts: np.ndarray) -> np.ndarray:
    return starts[:, None] + np.arange(shape.width)


def places(starts: np.ndarray, t: int) -> slice | np.ndarray:
    """Where the t-th records of the windows are: a slice if the windows follow each other."""
    n = len(starts)
    return slice(int(starts[0]) + t, int(starts[0]) + t + n) if n and starts[-1] - starts[0] == n - 1 and (np.diff(starts) == 1).all() else starts + t


def taken(fed: np.ndarray, starts: np.ndarray, t: int) -> np.ndarray:
    """Of each run (run, unit, record) the t-th records of the windows; starts: the same for all runs, or a row for each."""
    return fed[..., places(starts, t)] if starts.ndim == 1 else np.take_along_axis(fed, (starts + t)[:, None], 2)


def marked(shape: Shape, codes: np.ndarray, kind) -> np.ndarray:
    """A row for each record with a 1 at each of its codes."""
    out = np.zeros((len(codes), shape.features * shape.buckets), kind)
    out[np.arange(len(codes))[:, None], codes + np.arange(shape.features) * shape.buckets] = 1
    return out


#: Room for large arrays by name and type, as fresh memory costs more than what is reckoned in it. A process passes one block through at a time.
ROOM: dict[tuple, np.ndarray] = {}


def room(name: str, shape: tuple[int, ...], kind) -> np.ndarray:
    """An array that is good until the same name is asked for again, with whatever was in it."""
    key, n = (name, np.dtype(kind)), prod(shape)
    if key not in ROOM or ROOM[key].size < n:
        ROOM[key] = np.empty(n, kind)
    return ROOM[key][:n].reshape(shape)


def read(shape: Shape, w: dict, marks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The states (run, unit of both directions and a last one of 1, place, window), and what the way back needs; good until the next call."""
    h, n, width = shape.hidden, starts.shape[-1], shape.width
    x = marks @ w["codes"]
    runs, kind = len(x), x.dtype
    tilt = np.full((4 * h, 1), -1, kind)
    tilt[3 * h :] = -2  # a sigmoid is 1 / (1 + exp(-x)), a tanh a sigmoid of the double
    fed = room("fed", (runs, 2, 4 * h, len(marks)), kind)
    for k, d in enumerate(("on", "back")):
        np.matmul(w[f"{d}x"].transpose(0, 2, 1) * tilt, x.transpose(0, 2, 1), out=fed[:, k])
        fed[:, k] += w[f"{d}b"][:, :, None] * tilt
    recur = np.stack([w["onh"], w["backh"]], 1)
    turned = np.ascontiguousarray(recur.transpose(0, 1, 3, 2)) * tilt
    states, tape = room("states", (runs, 2 * h + 1, width, n), kind), []
    states[:, 2 * h] = 1
    zs, (cells, bents, lasts) = room("gates", (width, runs, 2, 4 * h, n), kind), room("cells", (3, width + 1, runs, 2, h, n), kind)
    cells[0], lasts[0] = 0, 0
    fresh = room("fresh", (runs, 2, h, n), kind)
    for t in range(width):
        z, c, bent, last = zs[t], cells[t + 1], bents[t], lasts[t + 1]
        on, back = taken(fed[:, 0], starts, t), taken(fed[:, 1], starts, width - 1 - t)
        if t:
            np.matmul(turned, lasts[t], out=z)
            z[:, 0] += on
            z[:, 1] += back
        else:
            z[:, 0], z[:, 1] = on, back
        with np.errstate(over="ignore"):  # 1 / inf is the 0 that is meant
            np.exp(z, out=z)
        z += 1
        np.reciprocal(z, out=z)
        new = z[:, :, 3 * h :]
        new *= 2
        new -= 1
        np.multiply(z[:, :, h : 2 * h], cells[t], out=c)
        c += np.multiply(z[:, :, :h], new, out=fresh)
        np.tanh(c, out=bent)
        np.multiply(z[:, :, 2 * h : 3 * h], bent, out=last)
        states[:, :h, t], states[:, h : 2 * h, width - 1 - t] = last[:, 0], last[:, 1]
        tape.append((z, cells[t], lasts[t], bent))
    return states, (x, recur, tape)


def unread(shape: Shape, w: dict, g: dict, marks: np.ndarray, starts: np.ndarray, back: np.ndarray, kept: tuple) -> None:
    """Fills in the gradients of all but the last layer. back: that of the states, as (run, unit, place, window)."""
    h, n, width, (x, recur, tape) = shape.hidden, len(starts), shape.width, kept
    runs, kind = len(x), x.dtype
    fed = room("fed", (runs, 2, 4 * h, x.shape[1]), kind)
    fed[:] = 0
    turned = np.zeros((runs, 2, 4 * h, h), kind)
    dh, dc, some = room("slopes", (3, runs, 2, h, n), kind)
    dh[:], dc[:] = 0, 0
    dz, slope = room("dz", (2, runs, 2, 4 * h, n), kind)
    for t in reversed(range(width)):
        z, before, last, bent = tape[t]
        dh[:, 0] += back[:, :h, t]
        dh[:, 1] += back[:, h : 2 * h, width - 1 - t]
        i, f, o, g_ = (z[:, :, k * h : (k + 1) * h] for k in range(4))
        np.multiply(bent, bent, out=some)
        np.subtract(1, some, out=some)
        some *= o
        some *= dh
        dc += some
        np.multiply(dc, g_, out=dz[:, :, :h])
        np.multiply(dc, before, out=dz[:, :, h : 2 * h])
        np.multiply(dh, bent, out=dz[:, :, 2 * h : 3 * h])
        np.multiply(dc, i, out=dz[:, :, 3 * h :])
        np.multiply(z, z, out=slope)
        np.subtract(z[:, :, : 3 * h], slope[:, :, : 3 * h], out=slope[:, :, : 3 * h])
        np.subtract(1, slope[:, :, 3 * h :], out=slope[:, :, 3 * h :])
        np.multiply(dz, slope, out=dz)
        if t:
            turned += np.matmul(dz, last.transpose(0, 1, 3, 2))
            np.matmul(recur, dz, out=dh)
            dc *= f
        fed[:, 0][..., places(starts, t)] += dz[:, 0]  # windows start at different records
        fed[:, 1][..., places(starts, width - 1 - t)] += dz[:, 1]
    dx = 0
    for k, d in enumerate(("on", "back")):
        g[f"{d}h"][:] = turned[:, k].transpose(0, 2, 1)
        g[f"{d}x"][:] = np.matmul(x.transpose(0, 2, 1), fed[:, k].transpose(0, 2, 1))
        g[f"{d}b"][:] = fed[:, k].sum(-1)
        dx = dx + np.matmul(w[f"{d}x"], fed[:, k])
    g["codes"][:] = np.matmul(marks.T, dx.transpose(0, 2, 1))


def last_layer(shape: Shape, w: dict) -> np.ndarray:
    """(run, part, class, unit and bias)."""
    return np.concatenate([w["out"], w["bias"][:, None]], 1).transpose(0, 2, 1).reshape(len(w["out"]), shape.parts, shape.classes, -1)


def odds(layer: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one part (class, place) what its classes' probabilities are in proportion to, at most 1, and the sum of it."""
    z = layer @ states
    z -= z.max(0)
    np.exp(z, out=z)
    return z, z.sum(0)


def loss_of(shape: Shape, right: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Focal cross entropy of each place, given the probability of its right class, and its slope (times that probability); 0 where nothing is known."""
    pt = np.clip(right, 1e-12, 1.0)
    log = np.log(pt)
    if not shape.focus:
        return np.where(known, -log, 0.0), -known.astype(pt.dtype)
    far = 1 - pt
    most = far**shape.focus
    return np.where(known, -most * log, 0.0), np.where(known, shape.focus * pt * far ** max(shape.focus - 1, 0) * log - most, 0.0).astype(pt.dtype)


def learn_all(shape: Shape, flats: np.ndarray, codes: np.ndarray, target: np.ndarray, starts: np.ndarray, use: np.ndarray, seeds: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each network the sum of the losses of the windows that it uses (run, window), the number of known places and parts, and the gradient. target: (record, part); seeds: of dropout."""
    w, width, units, kind = shape.split(flats), shape.width, 2 * shape.hidden, flats.dtype
    marks = marked(shape, codes, kind)
    states, kept = read(shape, w, marks, starts)
    drop = None
    if seeds is not None and shape.dropout > 0:
        drop = room("drop", (len(flats), units, width, len(starts)), kind)
        for out, own, seed in zip(drop, use, seeds):
            draw = np.random.default_rng(seed).random((units, width, int(own.sum())), np.float32) >= shape.dropout
            if own.all():
                out[:] = draw
            else:
                out[:] = 0
                out[:, :, own] = draw
        drop *= kind.type(1 / (1 - shape.dropout))
        states[:, :units] *= drop
    told = target[windows_of(shape, starts)].transpose(2, 1, 0)  # (part, place, window)
    layer, grad = last_layer(shape, w), np.zeros_like(flats)
    g, loss, n = shape.split(grad), np.zeros(len(flats)), np.zeros(len(flats), np.int64)
    back, at = room("back", (len(flats), units, width * len(starts)), kind), np.arange(width * len(starts))
    back[:] = 0
    for r in range(len(flats)):
        flat, out = states[r].reshape(units + 1, -1), np.empty(layer.shape[1:], kind)
        for part in range(shape.parts):
            known = ((told[part] >= 0) & use[r]).ravel()
            cls = np.where(known, told[part].ravel(), 0)
            p, total = odds(layer[r, part], flat)
            each, slope = loss_of(shape, p[cls, at] / total, known)
            p *= -slope / total
            p[cls, at] += slope
            out[part] = p @ flat.T
            back[r] += layer[r, part, :, :units].T @ p
            loss[r] += each.sum(dtype=np.float64)
            n[r] += int(known.sum())
        flat = out.reshape(-1, units + 1)
        g["out"][r], g["bias"][r] = flat[:, :units].T, flat[:, units]
    back = back.reshape(len(flats), units, width, -1)
    if drop is not None:
        back *= drop
    unread(shape, w, g, marks, starts, back, kept)
    return loss, n, grad


def learn(shape: Shape, flat: np.ndarray, codes: np.ndarray, target: np.ndarray, starts: np.ndarray, seed: int | None = None) -> tuple[float, int, np.ndarray]:
    """The same of one network over the windows at starts."""
    loss, n, grad = learn_all(shape, flat[None], codes, target, starts, np.ones((1, len(starts)), bool), None if seed is None else [seed])
    return float(loss[0]), int(n[0]), grad[0]


def judge_all(shape: Shape, flats: np.ndarray, codes: np.ndarray, target: np.ndarray, starts: np.ndarray, use: np.ndarray) -> list[tuple[float, int, int, int]]:
    """Of each network, over the windows that it uses of a row of starts (run, window): sum of losses, number of known places and parts, places all of whose parts are known, and those of them with all parts right."""
    w, out = shape.split(flats), []
    states, layer = read(shape, w, marked(shape, codes, flats.dtype), starts)[0].reshape(len(flats), 2 * shape.hidden + 1, -1), last_layer(shape, w)
    at = np.arange(states.shape[-1])
    for r in range(len(flats)):
        told, own = target[windows_of(shape, starts[r])].transpose(2, 1, 0).reshape(shape.parts, -1), np.tile(use[r], shape.width)
        every, right, loss, n = own.copy(), np.ones(len(own), bool), 0.0, 0
        for part in range(shape.parts):
            known = (told[part] >= 0) & own
            cls = np.where(known, told[part], 0)
            p, total = odds(layer[r, part], states[r])
            loss += float(loss_of(shape, p[cls, at] / total, known)[0].sum(dtype=np.float64))
            n, every = n + int(known.sum()), every & known
            right &= (p == 1).argmax(0) == cls  # the likeliest class, of equal ones the first
        out.append((loss, n, int(every.sum()), int((right & every).sum())))
    return out


def predict_all(shape: Shape, flats: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Classes (run, window, place, part). starts: (run, window)."""
    w = shape.split(flats)
    states = read(shape, w, marked(shape, codes, flats.dtype), starts)[0].reshape(len(flats), 2 * shape.hidden + 1, -1).transpose(0, 2, 1)
    told = np.stack([[(s @ one.T).argmax(-1) for one in layer] for s, layer in zip(states, last_layer(shape, w))])
    return told.reshape(len(flats), shape.parts, shape.width, -1).transpose(0, 3, 2, 1)


def predict(shape: Shape, flat: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Classes (window, place, part) of one network."""
    return predict_all(shape, flat[None], codes, starts[None])[0]
