"""Two small networks in numpy: a bottleneck that redraws a row, and a recurrent cell over a window.

Parameters are one flat array, cut into layers by shape.  Both kernels give the summed
loss of many rows and its gradient; the apply functions score whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Shapes = Sequence[tuple[int, ...]]


def cut(parameters: np.ndarray, shapes: Shapes) -> list[np.ndarray]:
    found, place = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        found.append(parameters[place : place + size].reshape(shape))
        place += size
    return found


def draw(shapes: Shapes, seed: int) -> np.ndarray:
    """Start values: weights by the fan-in of their layer, offsets zero."""
    rng = np.random.default_rng(seed)
    return np.concatenate(
        [rng.normal(0, 1 / np.sqrt(shape[0]), int(np.prod(shape))) if len(shape) > 1 else np.zeros(shape) for shape in shapes]
    )


# ---- perceptron ------------------------------------------------------------


def perceptron_shapes(size: int, hidden: int) -> Shapes:
    """Window -> hidden -> two classes, an offset with each, laid out as Spark's perceptron has them."""
    return [(size, hidden), (hidden,), (hidden, 2), (2,)]


def perceptron_kernel(shapes: Shapes, length: int):
    """Loss and gradient over the trailing windows of consecutive rows; rows of target -1 count in windows only."""

    def kernel(parameters: np.ndarray, rows: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray]:
        into, offset, out, ends = cut(parameters.astype(rows.dtype), shapes)
        step = rows.strides[1]
        count = len(rows) - length + 1
        windows = np.lib.stride_tricks.as_strided(rows, (count, length * rows.shape[1]), (step * rows.shape[1], step)).copy()
        target = targets[length - 1 :]
        held = target >= 0
        inner = windows @ into
        inner += offset
        np.clip(inner, -60, 60, out=inner)
        np.negative(inner, out=inner)
        np.exp(inner, out=inner)
        inner += 1
        np.reciprocal(inner, out=inner)
        turn = out[:, 1] - out[:, 0]
        apart = inner @ turn + (ends[1] - ends[0])
        loss = (np.logaddexp(0, apart) - target * apart)[held].sum(dtype=np.float64)
        miss = np.where(held, 1 / (1 + np.exp(-np.clip(apart, -60, 60))) - target, 0).astype(rows.dtype)
        last, final = inner.T @ miss, miss.sum(dtype=np.float64)
        slope = 1 - inner
        slope *= inner
        slope *= turn
        slope *= miss[:, None]
        gradient = [windows.T @ slope, slope.sum(0), np.stack([-last, last], 1), np.array([-final, final])]
        return float(loss), np.concatenate([part.ravel() for part in gradient]).astype(np.float64)

    return kernel


# ---- bottleneck -----------------------------------------------------------


def bottleneck_shapes(size: int, hidden: int, neck: int) -> Shapes:
    """Sensors -> hidden -> neck -> hidden -> sensors, an offset with each."""
    widths = (size, hidden, neck, hidden, size)
    return [shape for a, b in zip(widths, widths[1:]) for shape in ((a, b), (b,))]


def _layers(parameters: np.ndarray, shapes: Shapes, rows: np.ndarray) -> list[np.ndarray]:
    """Outputs of all layers; hidden ones pass through tanh, the last is plain."""
    parts, outputs = cut(parameters, shapes), [rows]
    for i in range(0, len(parts), 2):
        value = outputs[-1] @ parts[i] + parts[i + 1]
        outputs.append(value if i + 2 == len(parts) else np.tanh(value))
    return outputs


def redraw_errors(parameters: np.ndarray, shapes: Shapes, rows: np.ndarray) -> np.ndarray:
    """Mean squared difference between each row and what the network redraws."""
    return ((_layers(parameters, shapes, rows)[-1] - rows) ** 2).mean(1)


def bottleneck_kernel(shapes: Shapes):
    def kernel(parameters: np.ndarray, rows: np.ndarray, _targets: np.ndarray) -> tuple[float, np.ndarray]:
        parts, outputs = cut(parameters, shapes), _layers(parameters, shapes, rows)
        apart = outputs[-1] - rows
        back, gradient = 2 * apart / rows.shape[1], []
        for i in range(len(parts) - 2, -1, -2):
            below = outputs[i // 2]
            gradient = [(below.T @ back).ravel(), back.sum(0), *gradient]
            if i:
                back = (back @ parts[i].T) * (1 - below**2)
        return float((apart**2).mean(1).sum()), np.concatenate(gradient)

    return kernel


# ---- recurrent cell -------------------------------------------------------


def recurrent_shapes(size: int, hidden: int) -> Shapes:
    """One matrix for all four gates over (input, last output), their offsets, and the read-out."""
    return [(size + hidden, 4 * hidden), (4 * hidden,), (hidden, 1), (1,)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


_room = np.empty(0, np.uint8)


def _arrays(kind: np.dtype, *shapes: tuple[int, ...]) -> list[np.ndarray]:
    """Arrays in memory that the next call takes again: blocks follow each other, and new memory costs more than the sums."""
    global _room
    sizes = [int(np.prod(shape)) * kind.itemsize for shape in shapes]
    if len(_room) < sum(sizes):
        _room = np.empty(sum(sizes) * 5 // 4, np.uint8)
    found, place = [], 0
    for shape, size in zip(shapes, sizes):
        found.append(_room[place : place + size].view(kind).reshape(shape))
        place += size
    return found


def _steps(parameters: np.ndarray, shapes: Shapes, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Inputs, gates, states and their tanh at every time step, and the logit after the last one.

    Numbers have the kind of ``windows``; all but the logit hold until the next call.  A column for each window: what a step reads
    and writes lies together.  Inputs are (reading, last output, 1), so one product
    gives all four gates with their offsets; as sigmoid(x) = (1 + tanh(x / 2)) / 2, one tanh serves them all.
    """
    gates, offset, out, bias = cut(parameters, shapes)
    (n, length, size), hidden, kind = windows.shape, out.shape[0], windows.dtype
    half = np.repeat([0.5, 1.0], [3 * hidden, hidden])
    weights = np.ascontiguousarray((np.concatenate((gates, offset[None])) * half).T, kind)
    joined, opened, states, seen = _arrays(
        kind, (length + 1, size + hidden + 1, n), (length, 4 * hidden, n), (length, hidden, n), (length, hidden, n)
    )
    joined[:length, :size] = windows.transpose(1, 2, 0)
    joined[0, size:-1], joined[:, -1] = 0, 1
    for t in range(length):
        np.matmul(weights, joined[t], out=opened[t])
        np.tanh(opened[t], out=opened[t])
        opened[t, : 3 * hidden] += 1
        opened[t, : 3 * hidden] *= 0.5
        admit, hold, show, fresh = opened[t].reshape(4, hidden, n)
        np.multiply(admit, fresh, out=states[t])
        if t:
            states[t] += hold * states[t - 1]
        np.tanh(states[t], out=seen[t])
        np.multiply(show, seen[t], out=joined[t + 1, size:-1])
    return joined, opened, states, seen, out[:, 0].astype(kind) @ joined[length, size:-1] + kind.type(bias[0])


def failure_probabilities(parameters: np.ndarray, shapes: Shapes, windows: np.ndarray) -> np.ndarray:
    return _sigmoid(_steps(parameters, shapes, windows)[-1])


def recurrent_kernel(shapes: Shapes, length: int):
    """Cross entropy of the probability after a window of ``length`` rows, carried back through all of them.

    Computed in the kind of numbers that the rows have; single precision takes a third of the time.
    """

    def kernel(parameters: np.ndarray, rows: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray]:
        windows = rows.reshape(len(targets), length, -1)
        size, kind = windows.shape[2], windows.dtype
        gates, _, out, _ = cut(parameters, shapes)
        hidden = out.shape[0]
        joined, opened, states, seen, logit = _steps(parameters, shapes, windows)
        loss = np.logaddexp(0, logit) - targets * logit
        error = (_sigmoid(logit) - targets).astype(kind)
        d_out, d_bias = joined[length, size:-1] @ error, error.sum()
        back = np.ascontiguousarray(gates[size:], kind)
        d_output, d_state = out.astype(kind) * error, np.zeros((hidden, len(targets)), kind)
        d_weights, raw = np.zeros((4 * hidden, size + hidden + 1), kind), np.empty_like(opened[0])
        d_admit, d_hold, d_show, d_fresh = raw.reshape(4, hidden, -1)
        slope = np.empty_like(d_state)
        for t in range(length - 1, -1, -1):
            sigmoids, (admit, hold, show, fresh) = opened[t, : 3 * hidden], opened[t].reshape(4, hidden, -1)
            np.multiply(joined[t + 1, size:-1], seen[t], out=slope)  # show (1 - seen seen)
            np.subtract(show, slope, out=slope)
            slope *= d_output
            d_state += slope
            np.multiply(sigmoids, sigmoids, out=raw[: 3 * hidden])
            np.subtract(sigmoids, raw[: 3 * hidden], out=raw[: 3 * hidden])
            d_admit *= fresh
            d_admit *= d_state
            d_hold *= states[t - 1] if t else 0
            d_hold *= d_state
            d_show *= seen[t]
            d_show *= d_output
            np.multiply(fresh, fresh, out=d_fresh)
            np.subtract(1, d_fresh, out=d_fresh)
            d_fresh *= admit
            d_fresh *= d_state
            d_weights += raw @ joined[t].T
            if t:
                d_output = back @ raw
                d_state *= hold
        d_gates, d_offset = d_weights[:, :-1].T.ravel(), d_weights[:, -1]
        return float(loss.sum(dtype=np.float64)), np.concatenate((d_gates, d_offset, d_out, [d_bias])).astype(np.float64)

    return kernel
