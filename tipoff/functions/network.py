"""A small softplus network: 13 inputs, two hidden layers of 15, one output."""

import numpy as np

# Fixed values of the network.
HIDDEN = 15
INITIAL_RANGE = 0.1


def layer_shapes(inputs: int) -> list[tuple[int, int]]:
    return [(HIDDEN, inputs), (HIDDEN, HIDDEN), (1, HIDDEN)]


def parameter_count(inputs: int) -> int:
    return sum(rows * columns + rows for rows, columns in layer_shapes(inputs))


def initial_parameters(inputs: int, seed: int) -> np.ndarray:
    """Uniform weights, zero biases, as one flat vector (weights then bias, layer by layer)."""
    rng = np.random.default_rng(seed)
    parts = []
    for rows, columns in layer_shapes(inputs):
        parts += [rng.uniform(-INITIAL_RANGE, INITIAL_RANGE, rows * columns), np.zeros(rows)]
    return np.concatenate(parts)


def layers(theta: np.ndarray, inputs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    found, at = [], 0
    for rows, columns in layer_shapes(inputs):
        weight = theta[at : at + rows * columns].reshape(rows, columns)
        at += rows * columns
        found.append((weight, theta[at : at + rows]))
        at += rows
    return found


def _softplus(z):
    return np.logaddexp(0.0, z)


def _sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def forward(theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    first, second, last = layers(theta, x.shape[1])
    hidden = _softplus(x @ first[0].T + first[1])
    hidden = _softplus(hidden @ second[0].T + second[1])
    return (hidden @ last[0].T + last[1])[:, 0]


def weighted_gradient(theta: np.ndarray, x: np.ndarray, error) -> tuple[np.ndarray, np.ndarray]:
    """Outputs q, and the sum over rows of ``error(q)`` times the gradient of q."""
    first, second, last = layers(theta, x.shape[1])
    z1 = x @ first[0].T + first[1]
    h1 = _softplus(z1)
    z2 = h1 @ second[0].T + second[1]
    h2 = _softplus(z2)
    q = (h2 @ last[0].T + last[1])[:, 0]
    back3 = error(q)[:, None]
    back2 = back3 @ last[0] * _sigmoid(z2)
    back1 = back2 @ second[0] * _sigmoid(z1)
    parts = []
    for back, seen in ((back1, x), (back2, h1), (back3, h2)):
        parts += [(back.T @ seen).ravel(), back.sum(axis=0)]
    return q, np.concatenate(parts)


def jacobian(theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs q, and the gradient of every row's q as one row of a matrix."""
    first, second, last = layers(theta, x.shape[1])
    z1 = x @ first[0].T + first[1]
    h1 = _softplus(z1)
    z2 = h1 @ second[0].T + second[1]
    h2 = _softplus(z2)
    q = (h2 @ last[0].T + last[1])[:, 0]
    back2 = last[0] * _sigmoid(z2)
    back1 = back2 @ second[0] * _sigmoid(z1)
    by_row = lambda back, seen: (back[:, :, None] * seen[:, None, :]).reshape(len(x), -1)
    return q, np.hstack([by_row(back1, x), back1, by_row(back2, h1), back2, h2, np.ones((len(x), 1))])
