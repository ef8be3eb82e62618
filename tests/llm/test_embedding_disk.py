"""Near-duplicate embeddings: what the job leaves on disk, and links of pairs of blocks against brute force."""
import time
from pathlib import Path

import numpy as np
import pytest

from logcase.llm import embedding_dup


def unit_rows(n, width, seed):
    x = np.random.default_rng(seed).standard_normal((n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(k).getName() for k in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_disk_follows_the_vectors_and_shuffles_go(spark, monkeypatch):
    """Entries of tables are not written: what is, is a small multiple of the vectors, and shuffle files go with their job."""
    width, n = 64, 3000
    x = unit_rows(n, width, 1)
    written = []

    def materialize(df, name, real=embedding_dup.materialize):
        out = real(df, name)
        written.append(sum(p.stat().st_size for f in out.inputFiles()[:1] for p in Path(f.split(":", 1)[1].replace("//", "")).parent.rglob("*.parquet")))
        return out

    monkeypatch.setattr(embedding_dup, "materialize", materialize)
    table = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    before = shuffle_files(spark)
    found = embedding_dup.near_duplicates(table)
    assert 0 < sum(written) <= 2 * x.nbytes
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert found.where("n_links = 0 and kept").count() == n


@pytest.mark.parametrize("lookup, crowd, slot_bits, at_once", [(0, 0, 22, 1 << 20), (0, 0, 4, 50), (16, 400, 22, 1 << 20), (0, 1, 22, 1 << 20), (1e9, 0, 22, 1 << 20)])
def test_pairs_of_blocks_against_brute_force(monkeypatch, lookup, crowd, slot_bits, at_once):
    """However a member's links are found, by flips or by comparing, each counts once; blocks of other pairs do not meet."""
    for name, value in (("LOOKUP", lookup), ("CROWD", crowd), ("_SLOT_BITS", slot_bits), ("_PAIRS", at_once), ("_ROWS", 64), ("_TILE", 50)):
        monkeypatch.setattr(embedding_dup, name, value)
    rng = np.random.default_rng(4)
    centres = unit_rows(25, 32, 2)
    x = np.concatenate([centres[rng.integers(25, size=500)] * rng.choice([1, 7], (500, 1)), unit_rows(200, 32, 3)])
    x = (x + rng.choice([0.002, 0.01, 0.02], (700, 1)) * np.linalg.norm(x, axis=1, keepdims=True) * rng.standard_normal(x.shape)).astype(np.float32)[rng.permutation(700)]
    # pairs: a block with itself, two blocks, one member alone, a block whose other one is empty, two blocks
    pair = np.repeat([0, 1, 2, 3, 4], [250, 249, 1, 50, 150])
    side = np.concatenate([np.zeros(250, int), np.arange(249) >= 100, [0], np.ones(50, int), np.arange(150) >= 149]).astype(int)
    alone = np.isin(pair, [0, 2])
    times = rng.integers(1, 4, 700)
    unit = embedding_dup.units(x)
    meets = (pair[:, None] == pair) & (alone[:, None] & ~np.eye(700, dtype=bool) | (side[:, None] != side))
    near = meets & (unit @ unit.T >= embedding_dup.COSINE)
    links = embedding_dup.Links(times)
    rotation = embedding_dup.Rotation.fit(unit[:200], turns=5)
    embedding_dup.Members(pair, side, alone, x, rotation(unit), embedding_dup.COSINE).find(links)
    links.connect()
    assert near.sum() > 1000
    assert links.links.tolist() == (near @ times).tolist()
    least = np.arange(700)
    while True:
        new = np.minimum(least, np.where(near, least, 700).min(1))
        if (new == least).all():
            break
        least = new
    assert links.top.tolist() == least.tolist()
