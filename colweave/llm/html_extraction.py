"""Main text of HTML pages: a bidirectional LSTM in numpy labels every block of a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import NUMBERS, PATH_SLOTS, WORD_SLOTS, Block, block_vectors, split_blocks
from .html_training import training_pages

PATH_WIDTH, HIDDEN = 24, 24
INPUT = PATH_WIDTH + WORD_SLOTS + NUMBERS
TRAIN_PAGES, EPOCHS, BATCH = 2_500, 7, 32
#: Blocks of the pages that are labelled together, about; a longer page is labelled alone.
BATCH_BLOCKS = 8_192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lay(pages: list[list[Block]]) -> dict[str, np.ndarray]:
    """Pages side by side: (steps, pages, ...), shorter ones filled up and masked."""
    steps, n = max(map(len, pages)), len(pages)
    x = np.zeros((steps, n, WORD_SLOTS + NUMBERS), np.float32)
    mask = np.zeros((steps, n), np.float32)
    slot, at, share = [], [], []
    for j, blocks in enumerate(pages):
        words, numbers = block_vectors(blocks)
        x[: len(blocks), j] = np.hstack([words, numbers])
        mask[: len(blocks), j] = 1
        for k, block in enumerate(blocks):
            slot += block.path
            at += [k * n + j] * len(block.path)
    return {"x": x, "mask": mask, "slot": np.array(slot, np.int64), "at": np.array(at, np.int64)}


class BlockLabeller:
    """x -> forward and backward LSTM -> main text or not, for every block of a page."""

    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.w = {"path": draw.normal(0, 0.3, (PATH_SLOTS, PATH_WIDTH)), "out": draw.normal(0, 0.1, 2 * HIDDEN + INPUT), "bias": np.zeros(1)}
        for way in ("fw", "bw"):
            self.w[f"{way}_x"] = draw.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN))
            self.w[f"{way}_h"] = draw.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            self.w[f"{way}_b"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _input(self, laid: dict) -> np.ndarray:
        steps, n = laid["mask"].shape
        path = np.zeros((steps * n, PATH_WIDTH), np.float32)
        rows = self.w["path"][laid["slot"]]
        for k in range(PATH_WIDTH):
            path[:, k] = np.bincount(laid["at"], rows[:, k], steps * n)
        return np.concatenate([np.tanh(path).reshape(steps, n, PATH_WIDTH), laid["x"]], axis=2)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray) -> list[tuple]:
        """States by step: (gates, cell before, cell, hidden before, hidden)."""
        steps, n, _ = x.shape
        drive = x @ self.w[f"{way}_x"] + self.w[f"{way}_b"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        trace: list = [None] * steps
        for t in range(steps) if way == "fw" else range(steps - 1, -1, -1):
            z = drive[t] + h @ self.w[f"{way}_h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            new = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = np.split(gates, 3, axis=1)
            m = mask[t][:, None]
            c_next = (f * c + i * new) * m
            h_next = o * np.tanh(c_next) * m
            trace[t] = (i, f, o, new, c, c_next, h, h_next)
            c, h = c_next, h_next
        return trace

    def _forward(self, laid: dict):
        x = self._input(laid)
        traces = {way: self._run(way, x, laid["mask"]) for way in ("fw", "bw")}
        hidden = np.concatenate([np.stack([s[-1] for s in traces[way]]) for way in ("fw", "bw")] + [x], axis=2)
        return x, traces, hidden, _sigmoid(hidden @ self.w["out"] + self.w["bias"])

    def _gradients(self, laid: dict, y: np.ndarray) -> dict[str, np.ndarray]:
        x, traces, hidden, p = self._forward(laid)
        mask = laid["mask"]
        d_z = (p - y) * mask / mask.sum()
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"] = np.tensordot(d_z, hidden, ([0, 1], [0, 1]))
        g["bias"] = np.array([d_z.sum()])
        d_hidden = d_z[..., None] * self.w["out"]
        d_x = d_hidden[..., 2 * HIDDEN :].copy()
        for part, way in enumerate(("fw", "bw")):
            d_out = d_hidden[..., part * HIDDEN : (part + 1) * HIDDEN]
            d_h = np.zeros_like(d_out[0])
            d_c = np.zeros_like(d_out[0])
            drives = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            order = range(len(mask) - 1, -1, -1) if way == "fw" else range(len(mask))
            for t in order:
                i, f, o, new, c_before, c, h_before, _ = traces[way][t]
                m = mask[t][:, None]
                d_h = (d_h + d_out[t]) * m
                tc = np.tanh(c)
                d_c = (d_c + d_h * o * (1 - tc * tc)) * m
                d_zt = np.concatenate(
                    [d_c * new * i * (1 - i), d_c * c_before * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - new * new)], axis=1
                )
                drives[t] = d_zt
                g[f"{way}_h"] += h_before.T @ d_zt
                d_h, d_c = d_zt @ self.w[f"{way}_h"].T, d_c * f
            g[f"{way}_x"] = np.tensordot(x, drives, ([0, 1], [0, 1]))
            g[f"{way}_b"] = drives.sum(axis=(0, 1))
            d_x += drives @ self.w[f"{way}_x"].T
        d_path = (d_x[..., :PATH_WIDTH] * (1 - x[..., :PATH_WIDTH] ** 2)).reshape(-1, PATH_WIDTH)
        rows = d_path[laid["at"]]
        for k in range(PATH_WIDTH):
            g["path"][:, k] = np.bincount(laid["slot"], rows[:, k], PATH_SLOTS)
        return g

    def train(self, pages: list[tuple[list[Block], np.ndarray]], epochs: int = EPOCHS, seed: int = 1) -> None:
        """Adam over batches of pages of like length."""
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        pages = sorted(pages, key=lambda p: len(p[0]))
        batches = []
        for k in range(0, len(pages), BATCH):
            part = pages[k : k + BATCH]
            laid = _lay([blocks for blocks, _ in part])
            y = np.zeros_like(laid["mask"])
            for j, (blocks, main) in enumerate(part):
                y[: len(blocks), j] = main
            batches.append((laid, y))
        step = 0
        for epoch in range(epochs):
            for b in draw.permutation(len(batches)):
                step += 1
                rate = 0.01 * (1 - epoch / epochs)
                for k, grad in self._gradients(*batches[b]).items():
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad**2
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.w[k] = (self.w[k] - rate * move).astype(np.float32)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        out: list = [np.zeros(0, bool)] * len(pages)
        k = 0
        while k < len(order):
            size, part = 0, []
            while k < len(order) and (not part or (len(part) + 1) * len(pages[order[k]]) <= BATCH_BLOCKS):
                if pages[order[k]]:
                    part.append(order[k])
                k += 1
            if part:
                p = self._forward(_lay([pages[j] for j in part]))[-1]
                for column, j in enumerate(part):
                    out[j] = p[: len(pages[j]), column] > 0.5
        return out


def train_labeller() -> BlockLabeller:
    """Trained on TRAIN_PAGES made-up pages of fixed seed, the same each time."""
    labeller = BlockLabeller()
    labeller.train(training_pages(TRAIN_PAGES, seed=7))
    return labeller


def extract_text(pages: DataFrame, labeller: BlockLabeller | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    The whole html is cut into blocks; the labeller reads them as one sequence, in both directions,
    and the blocks it takes for main text are joined in page order by line breaks. Character
    references are decoded and white space inside a block is one space. Null or empty html, and a page
    without main text, give an empty text. Other columns are carried by nothing here; null and
    repeated ids keep their rows. No rows give no rows.
    """
    model = labeller or train_labeller()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = [split_blocks(page) for page in batch["html"]]
            texts = [
                "\n".join(block.text for block, main in zip(blocks, labels, strict=True) if main)
                for blocks, labels in zip(pages, model.label(pages), strict=True)
            ]
            yield pd.DataFrame(
                {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
