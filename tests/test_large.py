"""What only larger tables have: amplitudes beyond full scale, sums that fit by chance."""

import numpy as np
from tonestream.sources import flac

RNG = np.random.default_rng(11)


def file_of(blocks: list[np.ndarray], size: int, bits: int = 16) -> bytes:
    own = [flac.encode_frame(x, k, bits) for k, x in enumerate(blocks)]
    n = sum(x.shape[1] for x in blocks)
    return b"fLaC\x80\0\0\x22" + flac.stream_info(size, [*map(len, own)], 44100, len(blocks[0]), bits, n, bytes(16)) + b"".join(own)


def test_bytes_that_begin_no_number_are_no_frame_header():
    """within a frame's samples, where a header would have its number, 255 may stand."""
    whole = flac.encode_frame(RNG.integers(-100, 100, (1, 16)), 0, 16)
    assert flac.frame_header(whole, 0)
    for lead in (0x80, 0xBF, 0xFF):
        for last in range(256):  # whatever the sum
            assert flac.frame_header(whole[:4] + bytes([lead, *bytes(7), last]) + bytes(20), 0) is None


def test_frames_are_found_whose_samples_look_like_headers():
    """the places of frames, with a sync code and a 255 behind it in plain samples."""
    x = RNG.integers(-32768, 32768, (3, 1, 16))
    x[1, 0, 4:8] = [-8, 0x1298 - 32768, -256 + 5, 7]  # ff f8 92 98 ff 05 in plain samples
    raw = file_of([*x], 16)
    assert b"\xff\xf8\x92\x98\xff\x05" in raw
    assert [n for _, _, n in flac.frame_places(raw)] == [16, 16, 16]
    assert (np.concatenate(list(flac.read_frames(raw, strict=False)), axis=1) == np.concatenate([*x], axis=1)).all()


def test_channels_beyond_full_scale_fit_24_bits(spark, tmp_path):
    """events above 562 are amplitudes above 1."""
    assert_same(spark, events(tmp_path), "flac_stereo_round_trip")


def events(tmp_path) -> str:
    import duckdb

    values = "CASE WHEN event_id % 40 = 0 THEN 562 + 8.07 * (event_id // 40) % 400 ELSE value END"
    duckdb.sql(f"COPY (SELECT * REPLACE ({values} AS value) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    return str(tmp_path)


def assert_same(spark, d, *names):
    """A query's rows on the tables of a folder are those of its SQL."""
    from pathlib import Path

    import duckdb
    from tonestream.plans import registry

    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    for name in names:
        df = registry.queries()[name](spark, d)
        r = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(r), name


def test_sizes_have_no_unit_above_gib_and_round_as_printf(spark, tmp_path):
    """also where a key's cube has more than 64 bits, which SQL has no row for."""
    import duckdb
    from pyspark.sql import functions as F
    from tonestream.plans import observe, registry

    duckdb.sql(f"COPY (SELECT p_partkey + 1190000 * (i % 2) + 7000 * i AS p_partkey FROM '/root/testdata/sf0.001/part.parquet', range(4) t(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    assert_same(spark, str(tmp_path), "format_sizes")
    duckdb.sql(f"COPY (SELECT 7200000::BIGINT AS p_partkey) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    assert registry.queries()["format_sizes"](spark, str(tmp_path)).first()["size"] == f"{(7200000**3 * 3 + 1) / (1 << 30):.1f} GiB"
    sizes = [0, 1023, 1280, 1331, 1792, 3 << 18, 7 << 40]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", observe.bytes_column(F.col("n")).alias("s"))
    assert [r["s"] for r in df.collect()] == [observe.format_bytes(n) for n in sizes]


def test_left_justified_beyond_full_scale(spark, tmp_path):
    """the SQL doesn't clip."""
    assert_same(spark, events(tmp_path), "left_justify_12_in_16", "quantize_s16", "quantize_u8")


def test_rollup_beyond_full_scale(spark, tmp_path):
    """nor here, so that some samples above 1 stay within the tolerance."""
    assert_same(spark, events(tmp_path), "suite_rollup")


def test_files_are_made_and_scanned_on_all_cores(spark):
    """F8, F11: one small table of many rows is no single task."""
    from tonestream.plans import media, registry
    from tonestream.sources import mpeg

    sf = "/root/testdata/sf0.001"
    files = media.mp3_files(spark, sf)
    assert files.rdd.getNumPartitions() >= 4
    for name in ("encoder_negotiation", "bridge_cost_search"):
        assert registry.queries()[name](spark, sf).rdd.getNumPartitions() >= 4
    # packets of many files share a batch
    batches = mpeg.packets(files.coalesce(1)).mapInArrow(lambda it: (b.slice(0, 1) for b in it), "sid long, seq long, pts long, at long, data binary, rate int, layer int, kbps int")
    assert batches.count() == 1


def test_lines_are_requantized_batch_by_batch(spark, tmp_path):
    """no row is collected by stream."""
    assert not collects(spark, "mp3_requantize")
    assert_same(spark, events(tmp_path), "mp3_requantize")


def collects(spark, name: str) -> bool:
    from tonestream.plans import registry

    return "collect_list" in registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_buffers_become_floats_batch_by_batch(spark, tmp_path):
    """as F9."""
    assert not collects(spark, "buffer_to_float")
    assert_same(spark, events(tmp_path), "buffer_to_float")


def test_streams_that_are_alike_are_negotiated_once(monkeypatch):
    """F11"""
    from tonestream.plans import catalog, negotiate, system

    seen = []
    real = catalog.negotiate_route
    monkeypatch.setattr(catalog, "negotiate_route", lambda *a: seen.append(a) or real(*a))
    for channels in (9, 10, 9, 10, 9):
        assert system.flac_route(negotiate.Stream("lpcm", 48000, channels, "s32", 32)).result.channels == 8
    assert len(seen) <= 2


def test_reverb_with_short_delays_needs_no_arrays(monkeypatch):
    """the same as sample by sample, over several pushes, without a recursion for
    each handful of samples; long delays still go by arrays, to the same result."""
    from tonestream.operators import state

    seen = []
    real = state.recursion
    monkeypatch.setattr(state, "recursion", lambda *a: seen.append(1) or real(*a))
    x = RNG.normal(size=300)
    parts = [x[:7], x[7:7], x[7:150], x[150:]]
    for short in (state.SHORT, 0):
        monkeypatch.setattr(state, "SHORT", short)
        for stage, want in ((state.Comb(5, 0.84, 0.2), plain_comb(x)), (state.Allpass(1), plain_allpass(x))):
            assert np.allclose(np.concatenate([stage.push(p) for p in parts]), want, atol=1e-12)
        assert bool(seen) == (short == 0)


def plain_comb(x: np.ndarray) -> list[float]:
    buf, low, out = [0.0] * 5, 0.0, []
    for v in x:
        out.append(buf.pop(0))
        low = 0.8 * out[-1] + 0.2 * low
        buf.append(v + 0.84 * low)
    return out


def plain_allpass(x: np.ndarray) -> list[float]:
    old, out = 0.0, []
    for v in x:
        out.append(old - v)
        old = v + old * 0.5
    return out


def test_large_groups_are_dealt_in_waves_of_two_copies_at_most(spark, monkeypatch):
    """every two of a group meet once over all waves, as in one deal of all cells."""
    from tonestream.llm import near

    monkeypatch.setattr(near, "SIDE", 5)
    for m in (3, 5, 11, 24, 38):
        rows = spark.range(m).selectExpr("1L as block", "id as node", f"{m}L as m")
        met: dict[tuple[int, int], int] = {}
        for wave in range(-(-m // 5) // 2 + 1):
            cells: dict[int, list] = {}
            dealt = near.dealt(rows, "block", wave).collect()
            assert len(dealt) <= 2 * m
            for r in dealt:
                cells.setdefault(r["cell"], []).append((r["part"], r["node"]))
            for own in cells.values():
                two = len({p for p, _ in own}) > 1
                for p, a in own:
                    for q, b in own:
                        if a < b and (p != q or not two):
                            met[a, b] = met.get((a, b), 0) + 1
        # a cell of two parts of which one is empty has the other's pairs a second time
        assert set(met) == {(a, b) for a in range(m) for b in range(a + 1, m)}
