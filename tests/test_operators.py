"""Golden values and edge cases of the DataFrame operators."""

import pytest
from pyspark.sql import functions as F

from intervane.config import Settings
from intervane.functions import ass as A
from intervane.functions import names as N
from intervane.functions import script as S
from intervane.functions import timing as T
from intervane.operators import align as AL
from intervane.operators import bias as B
from intervane.operators import candidates as CA
from intervane.operators import coverage as CV
from intervane.operators import history as H
from intervane.operators import intervals as I
from intervane.operators import packets as P
from intervane.operators import piecewise as PW
from intervane.operators import vad as V
from intervane.sources import stores
from intervane.sources import subtitles as SU
from intervane.streaming import state as ST


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_time_formats(spark):
    got = one(spark, *[T.format_time(F.lit(x), "ass").alias(f"c{k}") for k, x in enumerate((61.239, 3599.999, 36000.5, -5.0))])
    assert list(got) == ["0:01:01.24", "1:00:00.00", "10:00:00.50", "0:00:00.00"]
    got = one(spark, *[T.format_time(F.lit(x), "srt").alias(f"c{k}") for k, x in enumerate((61.2394, 3599.9999))])
    assert list(got) == ["00:01:01,239", "01:00:00,000"]


def test_time_parse(spark):
    got = one(spark, T.parse_time(F.lit("0:01:01.24")).alias("a"), T.parse_time(F.lit("00:01:01,239")).alias("b"), T.parse_time(F.lit("x")).alias("c"), T.parse_time(F.lit("1:2")).alias("d"))
    assert got.a == pytest.approx(61.24) and got.b == pytest.approx(61.239) and got.c is None and got.d is None


def test_describe(spark):
    got = one(spark, T.describe(F.lit(1.0), F.lit(0.0)).alias("a"), T.describe(F.lit(1.0), F.lit(2.5)).alias("b"), T.describe(F.lit(1.042709), F.lit(-0.12)).alias("c"))
    assert list(got) == ["unchanged", "+2.500s", "x1.042709 -0.120s"]


def test_sane(spark):
    got = one(spark, *[T.sane(F.lit(s), F.lit(o)).alias(f"c{k}") for k, (o, s) in enumerate(((103.997, 0.98464), (-90.0, 1.0), (0.5, 1.3), (-29.0, 1.0)))])
    assert list(got) == [False, False, False, True]


def test_two_point_stretch(spark):
    m = one(spark, T.two_point(F.lit(1.85), F.lit(6.7), F.lit(5.0), F.lit(1420.0)).alias("m")).m
    assert 4.0 < m.scale * 712 + m.offset - 712 < 4.6


def test_tag_scaling():
    text = r"{\k30}a{\k25}b{\kf45}c{\k20}d{\k60}{\fad(200,300)\move(1,2,3,4,0,1500)\t(0,500,\fs20)\pos(5,6)}"
    assert A.scale_text(text, 25 / 24) == r"{\k31}a{\k26}b{\kf47}c{\k21}d{\k63}{\fad(208,313)\move(1,2,3,4,0,1563)\t(0,521,\fs20)\pos(5,6)}"
    assert A.scale_text(r"\k30 outside", 2.0) == r"\k30 outside" and A.scale_text("{\\t(1,\\fs2)}", 2.0) == "{\\t(1,\\fs2)}"
    assert A.strip_text("a{b{c}d}e}f") == "aef" and A.strip_text("a{open") == "a"


def bias(spark, values):
    return B.consensus(spark.createDataFrame([(1, float(v)) for v in values], "k int, shift double"), ["k"]).first()


def test_bias_consensus(spark):
    r = bias(spark, [0.21, 0.23, 0.21, -5.84, 0.23, 0.23, 0.21])
    assert r.bias == pytest.approx(0.22) and r.agreeing == 6
    for none in ([0.20, 2.50, -1.80, 5.00], [0.21, 0.21, 0.21, 3, -2, 7.5], [0.2, 0.2]):
        assert bias(spark, none).bias is None


def test_bias_moves_exact_only_by_default(spark):
    rows = [(1, k, "ConstantOffset" if k else "Exact", 1.0, 0.3 if k else 0.2) for k in range(4)]
    x = spark.createDataFrame(rows, "e int, file_id int, verdict string, scale double, shift double")
    assert B.correct(x, ["e"]).where("file_id = 0").first().bias != 0
    assert B.correct(x, ["e"], Settings(bias_moves_exact=False)).where("file_id = 0").first().bias == 0


def cues(spark, rows):
    x = spark.createDataFrame([(1, k, *map(float, r[:2]), r[2]) for k, r in enumerate(rows)], "k int, src_ix int, pts double, duration double, size int")
    return [(round(r.start, 3), round(r.stop, 3)) for r in P.cues(x, ["k"]).orderBy("src_ix").collect()]


def test_packets(spark):
    assert cues(spark, [(12.5, 2.0, 900)]) == [(12.5, 14.5)]
    assert cues(spark, [(10, 0, 900), (13, 0, 20), (20, 0, 900), (24.5, 0, 20)]) == [(10, 13), (20, 24.5)]
    assert cues(spark, [(5, 0, 900), (8, 2, 900), (20, 2, 900)])[0] == (5, 8)
    assert cues(spark, [(5, 0, 900), (50, 2, 900), (60, 2, 900)])[0] == (5, 15)
    assert cues(spark, [(100, 0, 900)]) == [(100, 102)]


def test_lookups(spark):
    m = spark.createDataFrame([(1, 1, 0, 127720), (1, 2, 0, 146065), (1, 2, 12, 166873), (2, -1, 0, 9), (2, 1, 0, 8)], "tvdb_id int, tvdb_season int, tvdb_offset int, anilist_id int")
    e = spark.createDataFrame([(1, 1, 12), (1, 2, 19), (2, 1, 30)], "tvdb_id int, season int, episode int")
    got = {(r.tvdb_id, r.season, r.episode, r["rank"]): (r.anilist_id, r.entry_episode) for r in CA.tvdb_lookups(e, m).collect()}
    assert got[1, 1, 12, 1] == (127720, 12) and got[1, 2, 19, 1] == (166873, 7) and got[1, 2, 19, 2] == (146065, 19) and got[2, 1, 30, 1] == (9, 30)


def test_lenient_int(spark):
    got = one(spark, *[N.lenient_int(F.lit(v).cast("string")).alias(f"c{k}") for k, v in enumerate(("123", "123,456", "", "text", None, '{"a":1}'))])
    assert list(got) == [123, 123, None, None, None, None]


def test_language_by_name(spark):
    got = one(spark, *[N.language(F.lit(v)).alias(f"c{k}") for k, v in enumerate(("x [CHS, JPN].ass", "x [JPN].ass", "x.chs.srt", "x.srt", "x 中日双语.ass"))])
    assert list(got) == ["Multilingual", "JapaneseOnly", "NoJapanese", "Unknown", "Multilingual"]


def test_fractional_episodes(spark):
    names = ("Show S01E23.5.ass", "Show - 12.5 [x].ass", "Show 5.1 FLAC.ass", "a 10.2 Mbps.mkv", None)
    got = one(spark, *[N.fractional_episode(F.lit(v).cast("string")).alias(f"c{k}") for k, v in enumerate(names)])
    assert [g and g.text for g in got] == ["23.5", "12.5", None, None, None]


def test_name_match(spark):
    v, s = N.release(F.lit("[Grp] Show - 05 (BD 1920x1080 HEVC FLAC) [0A1B2C3D].mkv")), N.release(F.lit("[grp] Show - 05 (Blu-ray 1080p HEVC FLAC).ass"))
    m = one(spark, N.match(v, s, F.lit(5)).alias("m")).m
    assert m.score == 100 and m.source_match and not m.exact
    m = one(spark, N.match(v, N.release(F.lit("Show - 06 [0a1b2c3d].ass")), F.lit(5)).alias("m")).m
    assert m.exact and m.score == 100
    m = one(spark, N.match(v, N.release(F.lit("[x] Show - 17.ass")), F.lit(5), F.lit(17)).alias("m")).m
    assert not m.episode_mismatch and m.score == 0
    assert one(spark, N.match(v, N.release(F.lit("[x] Show - 06.ass")), F.lit(5)).alias("m")).m.episode_mismatch


def test_releases_are_found_once_a_name(spark):
    """Matching by looked-up details equals matching row by row, nulls included, and a name is taken apart once however many files have it."""
    names = ["[Grp] Show - 05 (BD 1920x1080 HEVC FLAC) [0A1B2C3D].mkv", "[grp] Show - 05 (Blu-ray 1080p HEVC FLAC).ass", "Show - 06 [0a1b2c3d].ass", "[x] Show - 17.ass", "", None, "[ ] a - 3 (WEB 720p).srt"]
    f = spark.createDataFrame([(i, v, s) for i, (v, s) in enumerate((v, s) for v in names for s in names)] * 3, "id int, video string, name string")
    got = CA.with_releases(f, {"video": "_v", "name": "_s"}).select("id", N.agree(F.col("_v"), F.col("_s"), F.lit(5)).alias("m"))
    want = f.select("id", N.match(N.release(F.col("video")), N.release(F.col("name")), F.lit(5)).alias("m"))
    key = lambda d: sorted((x.id, tuple(x.m)) for x in d.collect())
    assert key(got) == key(want) and got.count() == f.count()
    assert spark.read.schema("_name string").parquet(CA.with_releases(f, {"video": "_v", "name": "_s"}).inputFiles()[0].rsplit("/", 1)[0]).count() == 6


def test_rejections(spark):
    rows = [(1, "a.ass", 900), (1, "b.zip", 900), (1, "c [WhisperAI].srt", 900), (1, "d.chs.ass", 900), (1, "e.rar", 9), (1, "f.txt", 900), (1, "g.srt", 499), (2, "h.zip", 9), (3, "i.chs.srt", 900), (3, "j.zip", 9)]
    x = spark.createDataFrame(rows, "entry_id int, name string, size long")
    got = {r.name[0]: r.rejection for r in CA.rejection(x, ["entry_id"]).collect()}
    assert got == {"a": "none", "b": "archive not needed", "c": "machine", "d": "no japanese", "e": "unreadable archive", "f": "extension", "g": "too small", "h": "none", "i": "no japanese", "j": "archive not needed"}
    assert CA.rejection(x, ["entry_id"], False).where("name = 'h.zip'").first().rejection == "archives disabled"


def test_script_shares(spark):
    r = one(spark, S.counts(F.lit("ひらがな カタ 漢字 abc! é𠀀")).alias("c")).c
    assert (r.kana, r.han, r.other) == (6, 2, 4)
    assert one(spark, S.classify(F.lit(0.43), F.lit(0.4), F.lit(300)).alias("a")).a == "Multilingual"


def test_coverage_with_ties_and_no_neighbours(spark):
    a = spark.createDataFrame([(1, k, t, t + 1) for k, t in enumerate([0.0, 0.0, 10.0, 20.0])], "k int, src_ix int, start double, stop double")
    b = spark.createDataFrame([(1, k, t, t + 1) for k, t in enumerate([0.5, 9.49, 30.0])], "k int, src_ix int, start double, stop double")
    r = CV.measure(a, b, ["k"]).first()
    assert r.reference_covered == pytest.approx(0.5) and r.probe_matched == pytest.approx(1 / 3)


def test_merge_and_gates(spark):
    x = spark.createDataFrame([(1, 0, 10), (1, 5, 7), (1, 10, 12), (1, 20, 21)], "k int, s long, e long")
    assert sorted((r.s, r.e) for r in I.merge(x, ["k"]).collect()) == [(0, 12), (20, 21)]
    c = spark.createDataFrame([(1, k, float(k * 10), k * 10 + 9.9) for k in range(30)] + [(2, 0, 1.0, 2.0)], "k int, src_ix int, start double, stop double")
    assert {r.k: r.gate for r in I.quality_gates(c, ["k"]).collect()} == {1: "always on", 2: "few"}
    assert I.quality_gates(c.where("k > 9"), ["k"]).count() == 0


def test_verdict_case_ends_before_the_shift_limit_when_scaled(spark):
    x = spark.createDataFrame([(1.042, 45.0, 0.9, 2.0), (1.0, 45.0, 0.9, 2.0), (1.0, 0.1, 0.9, 2.0), (1.0, 1.0, 0.9, 2.0), (1.0, 1.0, 0.4, 2.0)], "scale double, shift double, correlation double, peak_ratio double")
    y = AL.decide(x.withColumn("min_correlation", F.lit(0.5)).withColumn("karaoke", F.lit(False)))
    assert [r.verdict for r in y.collect()] == ["FramerateDrift", "Declined", "Exact", "ConstantOffset", "Declined"]


def test_credible_split(spark):
    rows = [([(0, 19, 1.0), (20, 40, 5.0)], 0.9, 0.5, 0.4, 0.9, 0.3), ([(0, 4, 1.0), (5, 40, 5.0)], 0.9, 0.5, 0.4, 0.9, 0.3), ([(0, 40, 1.0)], 0.9, 0.5, 0.4, 0.9, 0.3), ([(0, 19, 1.0), (20, 40, 5.0)], 0.9, 0.5, 0.4, 0.9, 0.85)]
    x = spark.createDataFrame(rows, "blocks array<struct<first_cue:int,last_cue:int,offset:double>>, split_correlation double, min_correlation double, global_correlation double, split_coverage double, global_coverage double")
    assert [r.credible for r in PW.credible(x).collect()] == [True, False, False, False]


def test_votes_batch_and_live_agree(spark):
    events = [("success", "A", 1), ("success", "A", 1), ("success", "B", 2), ("success", "b", 2), ("reject", "B", 0), ("success", None, 7), ("success", "C", 3), ("reject", "A", 0)]
    x = spark.createDataFrame([(1, k, *e) for k, e in enumerate(events)], "k long, seq long, outcome string, group string, entry_id long")
    now = ("", 0, 0)
    for o, g, e in events:
        now = ST.vote_next(now, o, g, e)
    r = H.vote(x, "k").first()
    assert (r.p_group, r.p_entry, r.votes) == now


def test_limiter_batch_and_live_agree(spark):
    at = [0] * 30 + [100, 61_000, 61_001, 200_000]
    x = spark.createDataFrame([(1, k, t) for k, t in enumerate(at)], "k long, seq long, at_ms long")
    last, want = [], []
    for t in at:
        t, last = ST.admit_next(last, t)
        want.append(t)
    assert [r.admitted_ms for r in H.admit(x, "k").orderBy("seq").collect()] == want
    assert want[24] == 0 and want[25] == 60_050


def test_log_batch_and_live_agree(spark):
    seen = ["Applied", "Declined", "Applied", "Declined"] * 7
    x = spark.createDataFrame([(1, k, s) for k, s in enumerate(seen)], "k long, seq long, status string")
    log = []
    for k, s in enumerate(seen):
        log = ST.log_next(log, k, s)
    assert [(r.seq, r.status) for r in H.statuses(x, "k").orderBy("seq").collect()] == log and len(log) == 20


STYLED = "[Script Info]\r\nTitle: t\r\n[V4+ Styles]\r\nFormat: Name\r\n[Events]\r\nFormat: Start, End, Text\r\nDialogue: 0:00:12.34,0:00:15.67,{\\k30}a, b\r\nComment: 0:00:01.00,0:00:02.00,x\r\nDialogue: 0:00:20.00,0:00:21.00,{\\an8}♪ ~\r\nDialogue: bad,0:00:21.00,y\r\nDialogue: 0:00:05.00,0:00:06.00,z"
PLAIN = "1\n00:00:01,000 --> 00:00:02,500 X1:1 X2:2\nhello\n\n2\n00:00:00,100 --> 00:00:00,900\nhi\n"


def test_documents_round_trip_and_rewrite(spark):
    d = spark.createDataFrame([(1, STYLED), (2, PLAIN), (3, ""), (4, None)], "doc_id long, content string")
    of = SU.lines(d)
    back = {r.doc_id: r.c for r in of.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "raw"))), lambda s: s["raw"]), "").alias("c")).collect()}
    assert back == {1: STYLED, 2: PLAIN}
    t = SU.timed(of)
    assert t.where("doc_id = 1").count() == 4 and t.where("doc_id = 2").count() == 2
    assert [r.timed_ix for r in SU.dialogue(t).where("doc_id = 1").orderBy("cue_ix").collect()] == [3, 0]
    assert {r.doc_id: r.karaoke for r in SU.karaoke(t).collect()} == {1: True, 2: False}
    moved = {r.doc_id: r for r in SU.rewrite(of, t, spark.createDataFrame([(1, 1.0, 2.5), (2, 1.0, -0.5)], "doc_id long, scale double, shift double")).collect()}
    assert "Dialogue:0:00:14.84,0:00:18.17,{\\k30}a, b\r\n" in moved[1].content and moved[1].content.startswith("[Script Info]\r\nTitle: t\r\n") and "Dialogue: bad,0:00:21.00,y" in moved[1].content
    assert moved[2].content == PLAIN.replace("00:00:01,000 --> 00:00:02,500", "00:00:00,500 --> 00:00:02,000").replace("00:00:00,100 --> 00:00:00,900", "00:00:00,000 --> 00:00:00,400") and moved[2].clamped == 1
    scaled = SU.rewrite(of, t, spark.createDataFrame([(1, 2.0, 0.0)], "doc_id long, scale double, shift double")).where("doc_id = 1").first()
    assert "{\\k60}a, b" in scaled.content
    same = SU.rewrite(of, t, spark.createDataFrame([(1, 1.0, 0.0)], "doc_id long, scale double, shift double")).where("doc_id = 1").first()
    assert same.content == STYLED and same.rewritten == 0


def test_decoding():
    text = "日本語テキスト"
    for raw, name in ((b"\xef\xbb\xbf" + text.encode(), "utf-8-bom"), (text.encode(), "utf-8"), (b"\xff\xfe" + text.encode("utf-16-le"), "utf-16le"), (text.encode("cp932"), "shift-jis")):
        assert SU.decode_bytes(raw) == (text, name)
    assert SU.decode_bytes(b"")[0] == "" and SU.decode_bytes(b"\xff\xff\x81")[1] == "latin-1"


def test_stamp_replaces_and_is_read(spark):
    d = spark.createDataFrame([(1, "ass", STYLED), (2, "srt", PLAIN)], "doc_id long, kind string, content string")
    x = SU.stamp(SU.stamp(d, F.lit("old")), F.lit("new | entry 3"))
    got = {r.doc_id: r for r in x.withColumn("note", SU.read_stamp(F.col("content"))).collect()}
    assert got[1].note == "new | entry 3" and got[1].content.count("; intervane:") == 1 and got[2].content == PLAIN


def test_stores(spark):
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("Show - 01.ass", "a")
        z.writestr("Show - 02.ass", "b")
        z.writestr("readme.txt", "c")
    m = stores.archive_members(spark.createDataFrame([("p", bytearray(buf.getvalue())), ("q", bytearray(b"no zip"))], "path string, content binary"))
    assert m.count() == 3 and bytes(stores.choose_member(m, F.lit(2)).first().content) == b"b" and stores.choose_member(m, F.lit(9)).count() == 0
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("Show - 02 z.srt", b"first"), ("Show - 02 a.srt", b"second"), ("Show - 03.srt", b""), ("Show - 04.srt", b"damaged " * 50)):
            z.writestr(name, text)
    raw = bytearray(whole.getvalue())
    at = raw.index(b"Show - 04.srt") + len("Show - 04.srt")
    raw[at : at + 4] = b"\xff\xff\xff\xff"
    m = stores.archive_members(spark.createDataFrame([("p", raw)], "path string, content binary"))
    assert sorted(r.member for r in m.collect()) == ["Show - 02 a.srt", "Show - 02 z.srt"]
    assert bytes(stores.choose_member(m, F.lit(2)).first().content) == b"first"
    maps = stores.id_mappings(spark.createDataFrame([('{"5":{"tvdb_id":12,"tvdb_season":"2","anilist_id":"7,8"},"x":{}}',)], "value string")).collect()
    assert [(r.anidb_id, r.tvdb_id, r.tvdb_season, r.tvdb_offset, r.anilist_id) for r in maps] == [(5, 12, 2, 0, 7)]


def test_remote_listing(spark, tmp_path):
    from intervane.sources import remote

    (tmp_path / "p1.jsonl").write_text('{"entry_id": 1, "name": "a", "anime": true}\n{"entry_id": 2, "name": "b", "anime": false}\n')
    x = remote.read(spark, str(tmp_path)).withColumn("k", F.lit(1))
    assert [r.name for r in remote.two_pass(x, ["k"]).collect()] == ["a"]


def test_vad_hears_bursts(spark):
    import numpy as np

    t = np.arange(512) / 16000
    rows = []
    for k in range(300):
        loud = (k // 30) % 2
        x = loud * 0.5 * np.sin(2 * np.pi * 700 * t) + 0.001 * np.random.default_rng(k).normal(size=512)
        rows.append((1, k, [float(v) for v in x]))
    s = V.scores(spark.createDataFrame(rows, "k int, frame_no int, samples array<double>"), "k")
    got = {r.frame_no: r.score for r in s.collect()}
    assert np.mean([got[k] for k in range(300) if (k // 30) % 2]) > np.mean([got[k] for k in range(300) if not (k // 30) % 2]) + 0.3
    assert V.detector("no such") is V.band_energy
