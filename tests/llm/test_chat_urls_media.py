from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import chat, media, urls

LOG = "conversation long, seq long, message long, kind string, role string, text string"


def slow_fold(events: list[tuple]) -> list[tuple[str, str]]:
    """Apply events one by one."""
    messages: dict[int, dict] = {}
    for _, seq, message, kind, role, text in sorted(events, key=lambda e: (e[1], e[3], e[4] or "", e[5] or "")):
        if kind == "regenerate":
            messages = {m: v for m, v in messages.items() if m <= message}
        m = messages.setdefault(message, {"role": "", "text": ""})
        m["role"] = m["role"] or role or ""
        m["text"] = m["text"] + (text or "") if kind == "delta" else text or ""
    return [(messages[m]["role"], messages[m]["text"]) for m in sorted(messages)]


def test_folding_against_a_replay(spark):
    rng = random.Random(5)
    log = []
    for c in range(30):
        seq, top = 0, rng.choice([3, 6])
        for m in range(top):
            log.append((c, seq := seq + 1, m, "message", ["user", "assistant"][m % 2], f"m{m}"))
            for _ in range(rng.randrange(4)):
                log.append((c, seq := seq + 1, m, rng.choice(["delta", "delta", "edit"]), None, rng.choice(["x", " é", None])))
        if rng.random() < 0.6:
            back = rng.randrange(top)
            log.append((c, seq := seq + 1, back, "regenerate", None, "again"))
            log.append((c, seq := seq + 1, back, "delta", None, "!"))
            log.append((c, seq := seq + 1, top, "message", "user", "new"))
    rng.shuffle(log)
    final = chat.final_messages(spark.createDataFrame(log, LOG))
    rendered = chat.parse(chat.render(final, ["message", "copy"]))
    got = {r.conversation: [(t.role, t.text) for t in r.turns] for r in rendered.collect()}
    assert got == {c: slow_fold([e for e in log if e[0] == c]) for c in range(30)}


def test_digest_and_hostile_texts(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "&lt;&amp;lt;", "&&lsqb;[", "", None, "line\n\n", "&NewLine;", "😀<é"]
    rows = [(c, t, ["user", "assistant", "system"][(c + t) % 3], nasty[(c * 3 + t) % len(nasty)], 1) for c in range(20) for t in range(5)]
    rows += [(50, 0, None, "x", 1), (50, 0, None, "x", 1), (None, 3, "a\nb", "y", 1), (60, None, "assistant", "z", 1)]
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    assert got[-7].n_turns == 2 and got[-7].loss_chars == 21
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        whole = "".join(f"{ro}\n{te}\n" for _, ro, te in turns)
        loss = "".join(te for _, ro, te in turns if ro == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(df.limit(0)).count() == 1


def test_mask_places(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", "a<b" * i) for i in range(2100)]
    log = spark.createDataFrame([(c, i, i, "message", r, t) for c, i, r, t in rows[:300]], LOG)
    r = chat.parse(chat.render(chat.final_messages(log), ["message", "copy"])).first()
    for t, (_, _, role, text) in zip(r.turns, rows, strict=False):
        written = r.formatted[t.start : t.stop]
        assert t.role == role and written.replace("&lt;", "<").replace("&amp;", "&") == text


def test_rules(spark):
    cases = [
        ("https://a.COM/x", "a.com", "/x", "com/", "allow"),
        ("http://m.example.com/en/1?x=/fr/", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://x.net/es/?a", "x.net", "/es/", "net/es/", "block"),
        ("http://x.net/esp/", "x.net", "/esp/", None, None),
        ("http://x.com", "x.com", "", None, None),
        ("http://x.com?/en/", "x.com", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("a://b://c.net/fr/", "b:", "//c.net/fr/", None, None),
        ("ftp://É.NET/fr/#", "É.net", "/fr/", "net/fr/", "block"),
    ]
    df = spark.createDataFrame([(i, c[0], 1) for i, c in enumerate(cases)], "page_id long, url string, rule int")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert urls.judge(df.limit(0)).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5) | (x[:, 2] > 0.9)).astype(float)
    model = urls.fit_trees(x[:2000], y[:2000])
    assert ((model.margin(x[2000:]) > 0) == (y[2000:] > 0.5)).mean() > 0.95
    assert urls.fit_trees(x[:0], y[:0]).margin(x[:3]).tolist() == [0.0] * 3


def test_held_out_urls(spark):
    rows = [(i, f"https://{'m' if i % 2 else 'www'}.{'casino-win' if i % 3 == 0 else 'news'}{i % 7}.example.{'net' if i % 3 == 0 else 'org'}/{'es' if i % 3 == 0 else 'en'}/{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = (("block", "net/es/"), ("allow", "org/"))
    ruled = urls.with_rules(df, rules).collect()
    model = urls.fit_urls(urls.with_rules(df.where("page_id % 4 <> 0"), rules))
    test = [r for r in ruled if r.page_id % 4 == 0]
    stats = {r.host: r.stats for r in urls.host_statistics(df.select(urls.host_and_path(F.col("url"))[0].alias("host")), model.statistics).collect()}
    right = model.block([(r.url, r.host, r.path, stats[r.host]) for r in test]) == np.array([r.rule_verdict == "block" for r in test])
    assert right.mean() > 0.95


def test_suffixes_are_counted_over_all_urls_by_brute_force(spark):
    rows = [(i, f"http://h{i % 50}.s{i % 11}.{'net' if i % 3 else 'org'}/{'es' if i % 2 else 'en'}/{i % 120}") for i in range(400)]
    rows += [(1000, None), (1001, "no scheme"), (1002, "http:///x"), (1003, "http://net/es/")] * 2
    ruled = urls.with_rules(spark.createDataFrame(rows, "page_id long, url string"), (("block", "net/es/"), ("allow", "org/")))
    got = {r.suffix: (r.bad, r.seen) for r in urls.fit_urls(ruled, max_rows=20).statistics.collect()}
    want = {}
    for r in {(r.url, r.host, r.rule_verdict) for r in ruled.collect() if r.rule_verdict}:
        labels = r[1].split(".")
        for k in range(1, min(3, len(labels)) + 1):
            bad, seen = want.get(".".join(labels[-k:]), (0, 0))
            want[".".join(labels[-k:])] = (bad + (r[2] == "block"), seen + 1)
    assert got == want
    hosts = {r.host: r.stats for r in urls.host_statistics(ruled, urls.suffix_statistics(ruled)).collect()}
    assert hosts["h0.s0.org"] == [n for k in ("org", "s0.org", "h0.s0.org") for n in want[k]] and hosts[""] == [0] * 6
    assert urls.hashed_sample(ruled, "page_id", 20).count() == 20


def test_verdicts_by_slow_trees(spark):
    """Every verdict again: suffixes counted in Python, each tree walked node by node."""
    rows = [(i, f"https://{'m' if i % 2 else 'www'}.{'casino-win' if i % 3 == 0 else 'news'}{i % 7}.example.{('net', 'org', 'com')[i % 5 % 3]}/{'es' if i % 3 == 0 else 'en'}/{i}?a={i % 4}&b") for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None), (901, "x")], "page_id long, url string")
    rules = (("block", "net/es/"), ("allow", "org/"))
    model = urls.fit_urls(urls.with_rules(df, rules))
    known = {r.suffix: (r.bad, r.seen) for r in model.statistics.collect()}
    got = {r.page_id: r for r in urls.judge(df, rules).collect()}
    assert len(got) == 302
    for r in urls.with_rules(df, rules).collect():
        if r.rule_verdict:
            assert (got[r.page_id].rule, got[r.page_id].verdict) == (r.rule, r.rule_verdict)
            continue
        labels = r.host.split(".")
        stats = [n for k in (1, 2, 3) for n in (known.get(".".join(labels[-k:]), (0, 0)) if k <= len(labels) else (0, 0))]
        x = urls.lexical_features(r.url or "", r.host, r.path, stats, model.prior)
        margin = model.trees.prior
        for feature, threshold, value in model.trees.trees:
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            margin += value[node - len(feature)]
        assert got[r.page_id].rule is None and got[r.page_id].verdict == ("block" if margin > 0 else "allow")


def test_media_round_trip(spark):
    texts = ["", None, "a", "é" * 288, "x" * 575, "y" * 576, "z" * 577, "w " * 60_000, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("feature", F.lit(2))
    got = {r.doc_id: r for r in media.media_columns(df).collect()}
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), got[i]
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert media.from_wav(bytes(r.media)) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert [p.frame for p in r.peaks] == sorted(p.frame for p in r.peaks)
    assert got[8].feature == got[9].feature and got[0].feature == got[1].feature
    assert media.media_columns(df.limit(0)).count() == 0


def test_frames_cover_the_end():
    for n in (576, 1152, 256, 100, 257):
        quiet = np.full(n, 128, np.uint8)
        quiet[-40:] = (128 + 100 * np.sin(np.arange(40) * 2 * np.pi / 8)).astype(np.uint8)
        assert (media.spectral_peaks(quiet)[-1] >= 0).any()


def test_fingerprints_by_direct_transform():
    rng = np.random.default_rng(2)
    samples = rng.integers(0, 256, 1728).astype(np.uint8)
    padded = np.concatenate([samples, np.full(64, 128, np.uint8)]).astype(float) - 128
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 255)
    peaks = []
    for start in range(0, len(padded) - 255, 128):
        part = padded[start : start + 256] * window
        size = [abs(sum(part * np.exp(-2j * np.pi * k * np.arange(256) / 256))) for k in range(128)]
        level = 2 * np.mean(size[2:])
        peaks.append([(low + int(np.argmax(size[low:high]))) if max(size[low:high]) > level else -1 for low, high in media.BANDS])
    assert media.spectral_peaks(samples).tolist() == peaks
    want = sorted(
        (f, a << 10 | b << 3 | d) for f in range(len(peaks)) for d in (1, 2) if f + d < len(peaks)
        for a in peaks[f] for b in peaks[f + d] if a >= 0 and b >= 0
    )
    assert [tuple(r) for r in media.fingerprints(samples).tolist()] == want


def test_peaks_find_a_tone():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 / media.FRAME * t)).astype(np.uint8)
    peaks = media.spectral_peaks(tone)
    assert (peaks[:, 2] == 20).all()
    assert len(media.fingerprints(tone)) >= len(peaks) - 2
