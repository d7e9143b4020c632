"""Contrastive loss over batches, and what each pair's gate does to it, in closed form.

A batch is scored in one task with matrix products: its size is the model's, not the data's. Utilities are then summed like
any others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def contrastive(u: np.ndarray, v: np.ndarray, scale: float = 20.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of both directions over rows of unit vectors, and its gradients."""
    n = len(u)
    s = scale * u @ v.T
    row = np.exp(s - s.max(axis=1, keepdims=True))
    col = np.exp(s - s.max(axis=0, keepdims=True))
    p, q = row / row.sum(axis=1, keepdims=True), col / col.sum(axis=0, keepdims=True)
    diagonal = np.arange(n)
    loss = -0.5 * float(np.mean(np.log(np.maximum(p[diagonal, diagonal], 1e-300))) + np.mean(np.log(np.maximum(q[diagonal, diagonal], 1e-300))))
    w = (p + q - 2 * np.eye(n)) * scale / (2 * n)
    return loss, w @ v, w.T @ u


def through_norm(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Gradient with respect to vectors from that with respect to their directions."""
    size = np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
    u = h / size
    return (g - (g * u).sum(axis=1, keepdims=True) * u) / size


def gate_gradient(dh: np.ndarray, merged: np.ndarray, left: np.ndarray, right: np.ndarray, denominator: np.ndarray) -> np.ndarray:
    """d loss / d gate of pairs whose sentence has the gradient ``dh``; what is along the sentence's own vector has no effect."""
    return np.einsum("ij,ij->i", dh, (merged - 0.5 * (left + right)) / np.maximum(denominator, 1e-3)[:, None])


def batch_losses(vectors: DataFrame, scale: float = 20.0) -> DataFrame:
    """(batch_id, loss, n) of rows (batch_id, slot, anchor, positive), vectors of any length; null vectors are left out."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("slot", kind="stable")
        h = [np.stack(batch[c].map(np.asarray)).astype(float) for c in ("anchor", "positive")]
        u, v = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in h)
        return pd.DataFrame({"batch_id": [batch["batch_id"].iloc[0]], "loss": [contrastive(u, v, scale)[0]], "n": [len(batch)]})

    return vectors.where("anchor IS NOT NULL AND positive IS NOT NULL").groupBy("batch_id").applyInPandas(run, "batch_id long, loss double, n long")


def vector_gradients(vectors: DataFrame, scale: float = 20.0) -> DataFrame:
    """(batch_id, slot, side, dh): the gradient of each sentence vector, side 0 for anchors and 1 for positives."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("slot", kind="stable")
        h = [np.stack(batch[c].map(np.asarray)).astype(float) for c in ("anchor", "positive")]
        unit = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in h]
        _, du, dv = contrastive(*unit, scale)
        parts = [pd.DataFrame({"batch_id": batch["batch_id"], "slot": batch["slot"], "side": side, "dh": list(through_norm(x, g))}) for side, (x, g) in enumerate(zip(h, (du, dv)))]
        return pd.concat(parts)

    return vectors.where("anchor IS NOT NULL AND positive IS NOT NULL").groupBy("batch_id").applyInPandas(run, "batch_id long, slot int, side int, dh array<double>")
