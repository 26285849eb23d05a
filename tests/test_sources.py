"""Tensor files, adapters' norms and tiled harvests, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import crawl
from tracewright.sources import tensors

# tensors


def bf16(x):
    return (np.asarray(x, np.float32).view(np.uint32) >> 16).astype(np.uint16)


@pytest.fixture(scope="module")
def adapter(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("adapter"), np.random.default_rng(4)
    whole = {}
    for k in range(4):
        name = f"base_model.model.layers.{k}.q_proj"
        whole[f"{name}.lora_A.weight"] = rng.normal(size=(6, 70)).astype(np.float32)
        whole[f"{name}.lora_B.weight"] = (rng.normal(size=(90, 6)) * (k > 0) * k).astype(np.float32 if k % 2 else np.float64)
    whole["base_model.model.layers.9.q_proj.lora_A.weight"] = np.ones((2, 3), np.float32)  # without its other factor
    whole["scale"] = np.array([2.5], np.float64)
    whole["none"] = np.zeros((0, 4), np.float32)
    whole["counts"] = np.arange(-3, 4, dtype=np.int16)
    items = list(whole.items())
    tensors.write_tensor_file(f"{folder}/a.safetensors", dict(items[:5]))
    tensors.write_tensor_file(f"{folder}/b.safetensors", dict(items[5:]))
    (folder / "adapter_config.json").write_text("{}")
    base = {f"layers.{k}.q_proj.weight": rng.normal(size=(90, 70)).astype(np.float32) for k in range(3)}
    tensors.write_tensor_file(f"{folder}/base/m.safetensors", base)
    return str(folder), whole, base


def read_back(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["name"], {})[r["at"]] = r["values"]
    return {n: np.array([v for _, part in sorted(p.items()) for v in part]) for n, p in out.items()}


@pytest.mark.parametrize("chunk", [1 << 18, 100, 7])
def test_tensors_are_read_back_in_parts(spark, adapter, chunk):
    folder, whole, _ = adapter
    df = tensors.read_tensors(spark, folder, chunk)
    got = read_back(df)
    assert got.keys() == whole.keys() and all(np.array_equal(got[n], t.astype(np.float64).ravel()) for n, t in whole.items())
    assert {r["name"]: tuple(r["shape"]) for r in df.select("name", "shape").distinct().collect()} == {n: t.shape for n, t in whole.items()}
    longest = max(r["n"] for r in df.select(F.size("values").alias("n")).collect())
    assert longest <= max(chunk, 7) or chunk == 1 << 18


def test_only_named_tensors_are_read(spark, adapter):
    folder, whole, _ = adapter
    df = tensors.read_tensors(spark, folder)
    assert df.where("name = 'scale'").rdd.getNumPartitions() == 1 and read_back(df.where("name = 'scale'")) == {"scale": [2.5]}
    some = df.where(F.col("name").startswith("base_model.model.layers.1."))
    assert some.rdd.getNumPartitions() == 2 and len(read_back(some)) == 2
    assert df.where("name IN ('scale', 'counts', 'x')").count() == 2 and df.where("name = 'x'").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        tensors.read_tensors(spark, "/tmp/nowhere-at-all").count()


def test_halves_of_floats(spark, tmp_path):
    x = np.array([[1.0, -2.5], [0.0, 3.140625]], np.float32)
    path = str(tmp_path / "h.safetensors")
    tensors.write_tensor_file(path, {"w": x.astype(np.float16)})
    assert read_back(tensors.read_tensors(spark, path))["w"].tolist() == x.astype(np.float16).astype(float).ravel().tolist()
    raw = bytearray(open(path, "rb").read())
    size = int.from_bytes(raw[:8], "little")
    raw[8 : 8 + size] = bytes(raw[8 : 8 + size]).replace(b'"F16" ', b'"F16"').replace(b'"F16"', b'"BF16"')
    raw[:8] = (size + 1).to_bytes(8, "little")
    raw[-8:] = bf16(x).tobytes()
    open(path, "wb").write(raw)
    assert read_back(tensors.read_tensors(spark, path))["w"].tolist() == [1.0, -2.5, 0.0, 3.140625]


@pytest.mark.parametrize("chunk", [1 << 18, 100])
def test_adapter_norms_are_those_of_products(spark, adapter, chunk):
    folder, whole, base = adapter
    weights = tensors.tensor_norms(tensors.read_tensors(spark, f"{folder}/base", chunk))
    got = {r["module"]: r for r in tensors.adapter_norms(tensors.read_tensors(spark, folder, chunk), 2.0, weights).collect()}
    assert len(got) == 4
    for k in range(4):
        name = f"base_model.model.layers.{k}.q_proj"
        a, b = (whole[f"{name}.lora_{s}.weight"].astype(float) for s in "AB")
        moved, w = 2.0 * np.linalg.norm(b @ a), base.get(f"layers.{k}.q_proj.weight")
        r = got[name]
        assert np.allclose([r["a_norm"], r["b_norm"], r["moved"]], [np.linalg.norm(a), np.linalg.norm(b), moved], rtol=1e-9)
        assert r["relative"] is None if w is None else np.isclose(r["relative"], moved / np.linalg.norm(w.astype(float)))
    norms = tensors.adapter_norms(tensors.read_tensors(spark, folder, chunk))
    m = tensors.movement(norms).first()
    assert (m["modules"], m["zero"], m["still"], m["b_min"]) == (4, 1, 1, 0.0)
    assert [r["module"][-8:-7] for r in tensors.most_moved(norms, 2).orderBy("rank").collect()] == ["3", "2"]


# harvests


PAGE, DEPTH = 4, 3
RECORDED = "region long, tile string, token string, attempt int, status int, places array<struct<id:string,name:string>>, next_token string"


def world(seed):
    """Responses to every tile, page and try of some regions: some throttled, lost or failing, some places without an id."""
    rng, rows = random.Random(seed), []
    for region in range(6):
        spots = [("".join(rng.choice("0123") for _ in range(DEPTH)), f"p{k}" if rng.random() < 0.9 else None, f"n{k}") for k in range(rng.choice([0, 3, 15, 60]))]
        spots += rng.sample(spots, len(spots) // 5)  # listed twice
        tiles = [""] + [t for d in range(1, DEPTH + 1) for t in ("".join(x) for x in np.array(np.meshgrid(*[list("0123")] * d)).T.reshape(-1, d))]
        for tile in tiles:
            own = [(i, n) for t, i, n in spots if t.startswith(tile)]
            pages = [own[i : i + PAGE] for i in range(0, max(1, len(own)), PAGE)]
            for k, page in enumerate(pages):
                token, after = (f"{tile}:{k}" if k else None), (f"{tile}:{k + 1}" if k + 1 < len(pages) else None)
                bad = rng.choice([0, 0, 0, 0, 1, 2]) if region != 4 else rng.choice([0, 0, 3]) if tile else 9
                for attempt in range(1, bad + 1):
                    if rng.random() < 0.8:
                        rows.append((region, tile, token, attempt, rng.choice([429, 504, 403]) if bad < 9 else 404, None, None))
                rows.append((region, tile, token, bad + 1, 200, page, after))
    return rows


def plain_crawl(rows, regions):
    answers = {(r, t, k, a): (s, p, n) for r, t, k, a, s, p, n in rows}
    places, told = {}, {}
    for region in regions:
        todo, found, failed, asked, split, waited = [("", 1, None, 1)], [], False, 0, 0, 0.0
        while todo:
            nexts = []
            for tile, page, token, attempt in todo:
                asked += 1
                status, got, after = answers.get((region, tile, token, attempt), (None, None, None))
                if status == 200:
                    found += [(tile, page, k, p) for k, p in enumerate(got)]
                    if after and page < 3:
                        nexts.append((tile, page + 1, after, 1))
                    elif after and len(tile) < DEPTH:
                        split += 1
                        nexts += [(tile + q, 1, None, 1) for q in "0123"]
                elif status in (None, 403, 429, 504) and attempt < 3:
                    waited += 5.0 * 3 ** (attempt - 1)
                    nexts.append((tile, page, token, attempt + 1))
                else:
                    failed = True
            todo = [] if failed else nexts
        kept, seen = [], set()
        for tile, page, _, (i, n) in sorted(found, key=lambda x: x[:3]):
            if i is None or i not in seen:
                kept.append((region, tile, page, i, n if i is None else None))
                seen.add(i)
        if not failed:
            places[region] = kept
        told[region] = (failed, None if failed else len(kept), asked, split, waited)
    return sorted((x for p in places.values() for x in p), key=str), told


@pytest.mark.parametrize("seed", [1, 2])
def test_crawls_are_those_of_one_request_after_the_other(spark, seed):
    rows = world(seed)
    regions = spark.createDataFrame([(k,) for k in [*range(6), 0]], "region long")
    places, told = crawl.crawl(regions, spark.createDataFrame(rows, RECORDED), attempts=3, depth=DEPTH)
    want_places, want_told = plain_crawl(rows, range(6))
    got = sorted(((r["region"], r["tile"], r["page"], r["place"]["id"], r["place"]["name"] if r["place"]["id"] is None else None) for r in places.collect()), key=str)
    assert got == want_places
    assert {r["region"]: tuple(r)[1:] for r in told.collect()} == want_told
    assert any(f for f, *_ in want_told.values()) and any(s for _, _, _, s, _ in want_told.values())


def test_tiles_of_a_box(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(10, 20), rng.uniform(-5, 3)) for _ in range(200)] + [(10.0, -5.0), (20.0, 3.0), (15.0, -1.0)]
    df = spark.createDataFrame(rows, "lat double, lng double")
    box = [F.lit(x) for x in (10.0, -5.0, 20.0, 3.0)]
    tile = crawl.tile_at(*box, F.col("lat"), F.col("lng"), 4)
    got = df.select("lat", "lng", tile.alias("t"), crawl.tile_box(*box, tile).alias("b")).collect()
    for r in got:
        b = r["b"]
        assert len(r["t"]) == 4 and b["south"] <= r["lat"] <= b["north"] and b["west"] <= r["lng"] <= b["east"]
        assert abs((b["north"] - b["south"]) - 10 / 16) < 1e-9 and abs((b["east"] - b["west"]) - 8 / 16) < 1e-9
    assert df.select(crawl.tile_box(*box, F.lit("")).alias("b")).first()["b"] == (10.0, -5.0, 20.0, 3.0)


def test_a_crawl_computes_responses_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def tell(tile):
        made.add(1)
        return tile

    regions = spark.createDataFrame([(k,) for k in range(3)], "region int")
    rows = [(k, "", None if n == 1 else f"t{n}", 1, 200, [], f"t{n + 1}" if n < 3 else None) for k in range(3) for n in (1, 2, 3)]
    recorded = spark.createDataFrame(rows, "region int, tile string, token string, attempt int, status int, places array<struct<id:string>>, next_token string")
    _, told = crawl.crawl(regions, recorded.withColumn("tile", tell("tile")))
    assert [r["n_requests"] for r in told.collect()] == [3] * 3 and made.value == len(rows)
