"""Preparation of decoded images (arrays of height x width x 3, RGB) for models.

These run inside the model hooks, on one image at a time, with NumPy alone.
"""

from __future__ import annotations

import numpy as np

# Mean and deviation of the training data of the visual backbone.
MEAN, DEVIATION = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def decoded(row) -> np.ndarray | None:
    """RGB of a row of Spark's image source (BGR, BGRA or grey); None if it wasn't decoded."""
    if row is None or row["height"] <= 0:
        return None
    x = np.frombuffer(bytes(row["data"]), np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[:, :, 2::-1]


def _weights(size: int, target: int, kernel, reach: float) -> np.ndarray:
    """target x size weights of a separable filter, widened where the image shrinks."""
    scale = size / target
    wide = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale - 0.5
    w = kernel((np.arange(size)[None, :] - centre[:, None]) / wide)
    w[np.abs(np.arange(size)[None, :] - centre[:, None]) > reach * wide] = 0
    return w / w.sum(1, keepdims=True)


def _linear(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * (x**3 - 5 * x**2 + 8 * x - 4), 0.0))


def _sinc(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


KERNELS = {"linear": (_linear, 1.0), "cubic": (_cubic, 2.0), "lanczos": (_sinc, 3.0)}


def resized(image: np.ndarray, height: int, width: int, kernel: str = "linear") -> np.ndarray:
    """The image at another size, as numbers from 0 to 255."""
    f, reach = KERNELS[kernel]
    out = np.einsum("ij,jkc->ikc", _weights(image.shape[0], height, f, reach), image.astype(float))
    return np.clip(np.einsum("kj,ijc->ikc", _weights(image.shape[1], width, f, reach), out), 0, 255)


def thumbnail(image: np.ndarray, most: int = 512) -> np.ndarray:
    """The image with no side longer than ``most``; smaller ones stay."""
    h, w = image.shape[:2]
    if max(h, w) <= most:
        return image
    return resized(image, max(1, round(h * most / max(h, w))), max(1, round(w * most / max(h, w))), "lanczos").round().astype(np.uint8)


def centre_square(image: np.ndarray) -> np.ndarray:
    side = min(image.shape[:2])
    top, left = (image.shape[0] - side) // 2, (image.shape[1] - side) // 2
    return image[top : top + side, left : left + side]


def tagger_input(image: np.ndarray, side: int = 448) -> np.ndarray:
    """1 x side x side x 3: the centre square, bicubic, BGR, from 0 to 1."""
    x = resized(centre_square(image), side, side, "cubic").round() / 255
    return np.ascontiguousarray(x[None, :, :, ::-1], np.float32)


def normalised(image: np.ndarray) -> np.ndarray:
    """3 x height x width, with the backbone's mean and deviation."""
    return ((image.astype(float) / 255 - MEAN) / DEVIATION).transpose(2, 0, 1).astype(np.float32)


def validation_input(image: np.ndarray | None, side: int = 224) -> np.ndarray:
    """An image that can't be read is all zeros."""
    return np.zeros((3, side, side), np.float32) if image is None else normalised(resized(image, side, side))


def training_input(image: np.ndarray | None, rng: np.random.Generator, side: int = 224) -> np.ndarray:
    """A random crop of the image at 256 x 256, flipped half of the time, varied in light, and a part erased at times.

    Light stands for the random policies of image libraries (two operations of brightness, contrast or none).
    """
    if image is None:
        return np.zeros((3, side, side), np.float32)
    x = resized(image, side + 32, side + 32)
    top, left = rng.integers(0, 33, 2)
    x = x[top : top + side, left : left + side]
    x = x[:, ::-1] if rng.random() < 0.5 else x
    for _ in range(2):
        factor = 1 + rng.uniform(-0.18, 0.18)
        x = (x, x * factor, (x - x.mean()) * factor + x.mean())[rng.integers(0, 3)]
    out = normalised(np.clip(x, 0, 255))
    if rng.random() < 0.15:
        area, shape = rng.uniform(0.02, 0.15) * side * side, np.exp(rng.uniform(np.log(0.3), np.log(3.3)))
        h, w = (int(min(side, max(1, round(np.sqrt(area * f))))) for f in (shape, 1 / shape))
        top, left = rng.integers(0, side - h + 1), rng.integers(0, side - w + 1)
        out[:, top : top + h, left : left + w] = 0
    return out
