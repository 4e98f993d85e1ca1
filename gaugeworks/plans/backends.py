"""What the active-learning loop needs of a model; scores are DataFrames keyed by id."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.expr import softmax


class ModelBackend(ABC):
    """Two methods are required; the others raise NotImplementedError unless a model has them."""

    @abstractmethod
    def predict_proba(self, ids: DataFrame) -> DataFrame:
        """(id, probs) of column ``id``."""

    @abstractmethod
    def get_embeddings(self, ids: DataFrame) -> DataFrame:
        """(id, embedding)."""

    def compute_gradients(self, ids: DataFrame) -> DataFrame:
        """(id, grad)."""
        raise NotImplementedError

    def spatial_logits(self, ids: DataFrame) -> DataFrame:
        """(id, cells): class logits of every cell."""
        raise NotImplementedError

    def mc_dropout_predict(self, ids: DataFrame) -> DataFrame:
        """(pass, id, probs)."""
        raise NotImplementedError

    def train_one_epoch(self, ids: DataFrame) -> dict:
        raise NotImplementedError


class BatchFunctionBackend(ModelBackend):
    """A model given as a function from a NumPy matrix of features to logits, run in Arrow batches on the executors.

    ``features`` has (id, features array<double>). ``forward(matrix, seed)`` returns logits;
    a seed other than None asks for a pass with dropout. ``embed(matrix)`` returns vectors;
    without it the features themselves are the embedding. ``gradient(matrix)`` returns one
    flattened gradient a row. ``train(ids_and_features)`` returns metrics on the driver.
    """

    def __init__(self, features: DataFrame, forward: Callable, embed: Callable | None = None, gradient: Callable | None = None, train: Callable | None = None, passes: int = 10):
        self.features, self.forward, self.embed, self.gradient, self.trainer, self.passes = features, forward, embed, gradient, train, passes

    def _apply(self, ids: DataFrame, function: Callable) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    lengths = np.unique(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
                    if len(lengths) > 1:
                        raise ValueError(f"rows have between {lengths[0]} and {lengths[-1]} features")
                    m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    out = np.asarray(function(m), dtype="float64").reshape(batch.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["id", "v"])

        rows = self.features.where(F.col("features").isNotNull()).join(ids.select("id"), "id", "left_semi").select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
        return rows.mapInArrow(run, "id long, v array<double>")

    def predict_proba(self, ids: DataFrame) -> DataFrame:
        forward = self.forward
        return self._apply(ids, lambda m: forward(m, None)).select("id", softmax(F.col("v")).alias("probs"))

    def get_embeddings(self, ids: DataFrame) -> DataFrame:
        embed = self.embed or (lambda m: m)
        return self._apply(ids, embed).withColumnRenamed("v", "embedding")

    def compute_gradients(self, ids: DataFrame) -> DataFrame:
        if self.gradient is None:
            raise NotImplementedError
        return self._apply(ids, self.gradient).withColumnRenamed("v", "grad")

    def mc_dropout_predict(self, ids: DataFrame) -> DataFrame:
        forward, out = self.forward, None
        for t in range(self.passes):
            one = self._apply(ids, lambda m, t=t: forward(m, t)).select(F.lit(t).alias("pass"), "id", softmax(F.col("v")).alias("probs"))
            out = one if out is None else out.unionByName(one)
        return out

    def train_one_epoch(self, ids: DataFrame) -> dict:
        if self.trainer is None:
            raise NotImplementedError
        return self.trainer(self.features.join(ids.select("id"), "id", "left_semi"))


class TableBackend(ModelBackend):
    """Stored model outputs: tables (id, probs), (id, embedding) and, where given, (id, grad), (id, cells), (pass, id, probs)."""

    def __init__(self, probs: DataFrame, embeddings: DataFrame, gradients: DataFrame | None = None, cells: DataFrame | None = None, samples: DataFrame | None = None):
        self.tables = {"probs": probs, "embeddings": embeddings, "gradients": gradients, "cells": cells, "samples": samples}

    def _of(self, name: str, ids: DataFrame) -> DataFrame:
        if self.tables[name] is None:
            raise NotImplementedError
        return self.tables[name].join(ids.select("id"), "id", "left_semi")

    def predict_proba(self, ids: DataFrame) -> DataFrame:
        return self._of("probs", ids)

    def get_embeddings(self, ids: DataFrame) -> DataFrame:
        return self._of("embeddings", ids)

    def compute_gradients(self, ids: DataFrame) -> DataFrame:
        return self._of("gradients", ids)

    def spatial_logits(self, ids: DataFrame) -> DataFrame:
        return self._of("cells", ids)

    def mc_dropout_predict(self, ids: DataFrame) -> DataFrame:
        return self._of("samples", ids)


def _torch():
    try:
        import torch
    except ImportError as e:
        raise ImportError("torch is not installed") from e
    return torch


def named_layer(module, name: str):
    """The part of a module at a dotted name; numbers are places in a sequence. AttributeError if there is none."""
    at = module
    for step in name.split("."):
        try:
            at = at[int(step)] if step.lstrip("-").isdigit() else getattr(at, step)
        except (IndexError, KeyError, TypeError) as e:
            raise AttributeError(f"{type(module).__name__} has no layer {name!r}") from e
    return at


def torch_forward(module, device: str = "cpu") -> Callable:
    """``forward`` for BatchFunctionBackend from a torch module that takes a feature matrix; dropout layers run for a seed."""
    torch = _torch()

    def forward(matrix, seed):
        module.eval()
        if seed is not None:
            torch.manual_seed(seed)
            for layer in module.modules():
                if "Dropout" in type(layer).__name__:
                    layer.train()
        with torch.no_grad():
            return module.to(device)(torch.as_tensor(matrix, dtype=torch.float32, device=device)).cpu().numpy()

    return forward


def torch_embed(module, layer: str, device: str = "cpu") -> Callable:
    """``embed`` for BatchFunctionBackend: what the named layer of a torch module puts out, one flat vector a row."""
    torch = _torch()

    def embed(matrix):
        module.eval()
        seen: list = []
        hook = named_layer(module, layer).register_forward_hook(lambda _module, _inputs, output: seen.append(output))
        try:
            with torch.no_grad():
                module.to(device)(torch.as_tensor(matrix, dtype=torch.float32, device=device))
        finally:
            hook.remove()
        return seen[-1].reshape(len(matrix), -1).cpu().numpy()

    return embed


def torch_gradient(module, device: str = "cpu") -> Callable:
    """``gradient`` for BatchFunctionBackend: for each row all parameters' gradients of its loss against its own most probable class."""
    torch = _torch()

    def gradient(matrix):
        import numpy as np

        module.eval()
        module.to(device)
        rows = []
        for row in torch.as_tensor(matrix, dtype=torch.float32, device=device):
            module.zero_grad()
            logits = module(row.reshape(1, -1))
            torch.nn.functional.cross_entropy(logits, logits.argmax(dim=1)).backward()
            rows.append(np.concatenate([p.grad.reshape(-1).cpu().numpy() for p in module.parameters() if p.grad is not None]))
        return np.stack(rows)

    return gradient


def torch_trainer(module, labels: DataFrame, learning_rate: float = 1e-3, batch_rows: int = 32, device: str = "cpu") -> Callable:
    """``train`` for BatchFunctionBackend: one epoch over (id, features) joined with labels (id, label), on the driver.

    Rows come in the order of their ids, a batch at a time, so the driver holds one batch.
    Returns the mean loss of the batches.
    """
    torch = _torch()

    def train(rows: DataFrame) -> dict:
        module.train()
        module.to(device)
        optimiser = torch.optim.Adam(module.parameters(), lr=learning_rate)
        losses = []
        for batch in _batches(rows.join(labels.select("id", "label"), "id").orderBy("id").select("features", "label").toLocalIterator(), batch_rows):
            x = torch.as_tensor([r["features"] for r in batch], dtype=torch.float32, device=device)
            y = torch.as_tensor([r["label"] for r in batch], dtype=torch.long, device=device)
            optimiser.zero_grad()
            loss = torch.nn.functional.cross_entropy(module(x), y)
            loss.backward()
            optimiser.step()
            losses.append(float(loss.item()))
        return {"loss": sum(losses) / len(losses) if losses else 0.0, "batches": len(losses)}

    return train


def _batches(rows: Iterator, size: int) -> Iterator[list]:
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def keras_forward(model) -> Callable:
    """``forward`` for BatchFunctionBackend from a Keras model; its output is taken as logits."""
    return lambda matrix, seed: model(matrix.astype("float32"), training=seed is not None).numpy()


def keras_embed(model, layer: int | str = -2) -> Callable:
    """``embed`` for BatchFunctionBackend: what a Keras model's layer, by place or name, puts out."""
    import keras

    part = model.layers[layer] if isinstance(layer, int) else model.get_layer(layer)
    inner = keras.Model(inputs=model.inputs, outputs=part.output)
    return lambda matrix: inner(matrix.astype("float32"), training=False).numpy().reshape(len(matrix), -1)


def keras_trainer(model, labels: DataFrame, batch_rows: int = 32) -> Callable:
    """``train`` for BatchFunctionBackend: one epoch of ``train_on_batch`` of a compiled Keras model, on the driver, as in ``torch_trainer``."""

    def train(rows: DataFrame) -> dict:
        import numpy as np

        losses = []
        for batch in _batches(rows.join(labels.select("id", "label"), "id").orderBy("id").select("features", "label").toLocalIterator(), batch_rows):
            out = model.train_on_batch(np.array([r["features"] for r in batch], dtype="float32"), np.array([r["label"] for r in batch]))
            losses.append(float(np.ravel(out)[0]))
        return {"loss": sum(losses) / len(losses) if losses else 0.0, "batches": len(losses)}

    return train
