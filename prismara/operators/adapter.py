"""Training of the adapter on bounded, in-memory data, with checkpoints.

Spark prepares pairs (``image_path, visual, text``); the optimisation loop runs on
the driver over at most ``most`` pairs, a documented bound, as one small network.
"""

from __future__ import annotations

import json
import math
from pathlib import Path

import numpy as np

from prismara.operators.fusion import forward, random_adapter, save_adapter
from prismara.operators.training import learning_rate, total_steps


def loss_and_gradient(pred: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean combined loss of a batch, and its gradient in ``pred``."""
    n, d = pred.shape
    norm = np.maximum(np.linalg.norm(pred, axis=1, keepdims=True), 1e-12)
    p = pred / norm
    t = target / np.maximum(np.linalg.norm(target, axis=1, keepdims=True), 1e-12)
    cos = (p * t).sum(1, keepdims=True)
    value = 0.7 * (1 - cos.mean()) + 0.3 * ((p - t) ** 2).mean() + 0.001 * (pred**2).mean()
    inner = -0.7 * t / n + 0.3 * 2 * (p - t) / (n * d)
    grad = (inner - p * (inner * p).sum(1, keepdims=True)) / norm + 0.002 * pred / (n * d)
    return float(value), grad


class Adapter:
    """The adapter's layers with gradients, AdamW and a moving average of the weights."""

    def __init__(self, widths: tuple[int, ...], seed: int = 42, decay: float = 0.999):
        self.layers = random_adapter(widths, seed)
        self.shadow = [{k: v.copy() for k, v in layer.items()} for layer in self.layers]
        self.decay, self.steps = decay, 0
        self.moments = [{k: (np.zeros_like(v), np.zeros_like(v)) for k, v in layer.items()} for layer in self.layers]

    def run(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        kept = []
        for layer in self.layers:
            z = x @ layer["w"].T + layer["b"]
            if "scale" in layer:
                mean, std = z.mean(1, keepdims=True), np.sqrt(z.var(1, keepdims=True) + 1e-5)
                hat = (z - mean) / std
                y = hat * layer["scale"] + layer["shift"]
                cdf = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(y / math.sqrt(2)))
                kept.append((x, hat, std, y, cdf))
                x = y * cdf
            else:
                kept.append((x,))
                x = z
        return x, kept

    def gradients(self, x: np.ndarray, target: np.ndarray) -> tuple[float, list[dict[str, np.ndarray]]]:
        """Loss of a batch and its gradient in every weight."""
        pred, kept = self.run(x)
        value, g = loss_and_gradient(pred, target)
        grads: list[dict[str, np.ndarray]] = [{} for _ in self.layers]
        for i in reversed(range(len(self.layers))):
            layer, own = self.layers[i], kept[i]
            if "scale" in layer:
                inp, hat, std, y, cdf = own
                g = g * (cdf + y * np.exp(-(y**2) / 2) / math.sqrt(2 * math.pi))
                grads[i] |= {"scale": (g * hat).sum(0), "shift": g.sum(0)}
                h = g * layer["scale"]
                g = (h - h.mean(1, keepdims=True) - hat * (h * hat).mean(1, keepdims=True)) / std
            else:
                inp = own[0]
            grads[i] |= {"w": g.T @ inp, "b": g.sum(0)}
            g = g @ layer["w"]
        return value, grads

    def update(self, grads: list[dict[str, np.ndarray]], rate: float, clip: float = 1.0, decay: float = 0.01) -> None:
        """One step of AdamW on clipped gradients, and of the moving average."""
        size = math.sqrt(sum(float((v**2).sum()) for gr in grads for v in gr.values()))
        factor = min(1.0, clip / max(size, 1e-12))
        self.steps += 1
        for layer, gr, mom, shade in zip(self.layers, grads, self.moments, self.shadow):
            for k, v in gr.items():
                m, s = mom[k]
                m += 0.1 * (v * factor - m)
                s += 0.001 * ((v * factor) ** 2 - s)
                layer[k] -= rate * (m / (1 - 0.9**self.steps) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-8) + decay * layer[k])
                shade[k] += (1 - self.decay) * (layer[k] - shade[k])

    def step(self, x: np.ndarray, target: np.ndarray, rate: float, clip: float = 1.0, decay: float = 0.01) -> float:
        value, grads = self.gradients(x, target)
        self.update(grads, rate, clip, decay)
        return value

    def state(self) -> dict[str, np.ndarray]:
        """Weights, moving averages, moments and the step, by name."""
        out = {"steps": np.array(self.steps)}
        for i, (layer, shade, mom) in enumerate(zip(self.layers, self.shadow, self.moments)):
            for k in layer:
                out |= {f"layer.{i}.{k}": layer[k], f"shadow.{i}.{k}": shade[k], f"first.{i}.{k}": mom[k][0], f"second.{i}.{k}": mom[k][1]}
        return out

    def restore(self, held) -> None:
        self.steps = int(held["steps"])
        for i, (layer, shade, mom) in enumerate(zip(self.layers, self.shadow, self.moments)):
            for k in layer:
                layer[k][...], shade[k][...] = held[f"layer.{i}.{k}"], held[f"shadow.{i}.{k}"]
                mom[k][0][...], mom[k][1][...] = held[f"first.{i}.{k}"], held[f"second.{i}.{k}"]

    def parameters(self) -> int:
        return sum(v.size for layer in self.layers for v in layer.values())


def _validated(layers: list[dict[str, np.ndarray]], x: np.ndarray, y: np.ndarray, batch: int) -> tuple[float, float]:
    """Means over batches of the loss and of the cosine."""
    values, cosines = [], []
    for part in np.array_split(np.arange(len(x)), max(1, -(-len(x) // batch))):
        pred = forward(layers, x[part])
        values.append(loss_and_gradient(pred, y[part])[0])
        p, t = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (pred, y[part]))
        cosines.append(float((p * t).sum(1).mean()))
    return float(np.mean(values)), float(np.mean(cosines))


def train(x: np.ndarray, y: np.ndarray, val_x: np.ndarray, val_y: np.ndarray, folder: str, epochs: int = 30, batch: int = 32, accumulate: int = 2, peak: float = 3e-4, patience: int = 5, noise: float = 0.02, seed: int = 42, dataset: str = "", most: int = 200_000, resume: bool = False, best_copy: str | None = None) -> list[dict]:
    """Trains on at most ``most`` pairs; writes each epoch's log and state, the best weights and the final ones. Returns the log.

    Gradients of ``accumulate`` batches are averaged before a step, those of an epoch's last
    step too if they are fewer. The moving average of the weights is what is validated and kept as best,
    in ``folder`` and, if given, as ``best_copy``. ``resume`` goes on after the last epoch that was written.
    """
    if len(x) > most:
        raise ValueError(f"the driver trains on at most {most} pairs, not {len(x)}")
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    net = Adapter((x.shape[1], 512, 256, y.shape[1]), seed)
    log, best, waited, begin = [], math.inf, 0, 0
    state, last = out / "best_val_loss.json", out / "state.npz"
    if state.exists():
        stored = json.loads(state.read_text())
        best = stored["best_val_loss"] if stored.get("dataset_hash") == dataset else math.inf
    if resume and last.exists():
        with np.load(last) as held:
            net.restore(held)
            begin, waited, best = int(held["epoch"]) + 1, int(held["waited"]), float(held["best"])
        log = json.loads((out / "log.json").read_text())[:begin]
    batches = max(1, -(-len(x) // batch))
    steps = total_steps(len(x), batch, accumulate, epochs)
    for epoch in range(begin, epochs):
        # An epoch's order and noise depend on its number alone, so that a resumed run is the same.
        rng = np.random.default_rng((seed, epoch))
        losses, held = [], None
        for i, part in enumerate(np.array_split(rng.permutation(len(x)), batches)):
            value, grads = net.gradients(x[part], y[part] + rng.normal(0, noise, (len(part), y.shape[1])))
            losses.append(value)
            grads = [{k: v / accumulate for k, v in g.items()} for g in grads]
            held = grads if held is None else [{k: a[k] + b[k] for k in a} for a, b in zip(held, grads)]
            if (i + 1) % accumulate == 0 or i + 1 == batches:
                net.update(held, learning_rate(net.steps, steps, peak))
                held = None
        val, cosine = _validated(net.shadow, val_x, val_y, batch)
        log.append({"epoch": epoch, "train_loss": float(np.mean(losses)), "val_loss": val, "val_cos_sim": cosine, "lr": learning_rate(net.steps, steps, peak)})
        (out / "log.json").write_text(json.dumps(log))
        improved = val < best
        best, waited = (val, 0) if improved else (best, waited + 1)
        save_adapter(net.layers, str(out / f"epoch_{epoch:03d}.npz"))
        np.savez(out / "state.npz", **net.state(), epoch=epoch, waited=waited, best=best)
        if improved:
            for path in (str(out / "best_adapter.npz"), best_copy):
                if path:
                    save_adapter(net.shadow, path)
            state.write_text(json.dumps({"best_val_loss": best, "dataset_hash": dataset}))
        elif waited >= patience:
            break
    save_adapter(net.layers, str(out / "final_adapter.npz"))
    return log
