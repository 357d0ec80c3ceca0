"""The models' verdicts on whole URLs against brute force, with common grams, clashing columns and hot URLs."""

import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from pricelake.llm import url_filter

SCHEMA = "page_id long, url string, host string, path string, rule string, verdict int, score string, text string"


def smoothed(counts, totals, kinds):
    def chance(gram):
        below = 1 / url_filter.ALPHABET if len(gram) == 1 else chance(gram[1:])
        key = len(gram) - 1, gram[:-1]
        n, types = totals[key], len(kinds[key])
        return (counts[gram] + types * below) / (n + types) if n else below

    return chance


def brute(rows, order=url_filter.ORDER):
    def rule(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(n + p), v) for v, n, p in url_filter.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
        return max(fits, default=(0, None))[1]

    texts = Counter((u or "", rule(u)) for _, u in rows)
    held = {t: zlib.crc32(t.encode()) % 5 == 0 for t, _ in texts}
    grams = lambda t: [(url_filter._START * order + t + url_filter._END)[i : i + order + 1] for i in range(len(t) + 1)]
    models = {}
    for what in ("allow", "block"):
        counts, totals, kinds = Counter(), Counter(), defaultdict(set)
        for (t, says), n in texts.items():
            if says == what and not held[t]:
                for g in grams(t):
                    for k in range(order + 1):
                        counts[g[order - k :]] += n
                        totals[k, g[order - k : -1]] += n
                        kinds[k, g[order - k : -1]].add(g[-1])
        models[what] = smoothed(counts, totals, kinds)
    score = {t: np.mean([math.log(models["allow"](g)) - math.log(models["block"](g)) for g in grams(t)]) for t, _ in texts}
    sums = defaultdict(Counter)
    for (t, says), n in texts.items():
        if says and held[t]:
            sums[says][max(-url_filter.STEPS, min(url_filter.STEPS, round(score[t] / url_filter.STEP)))] += n
    limit = 0.0
    if sums["allow"] and sums["block"]:
        share = lambda says, keep: Fraction(sum(n for s, n in sums[says].items() if keep(s)), sum(sums[says].values()))
        errors = [(share("allow", lambda s: s < t) + share("block", lambda s: s >= t), abs(t), t) for t in range(-url_filter.STEPS, url_filter.STEPS + 1)]  # noqa: B023
        limit = (min(errors)[2] - 0.5) * url_filter.STEP
    return sorted(((i, rule(u) or ("allow" if score[u or ""] >= limit else "block"), round(score[u or ""], 9)) for i, u in rows), key=repr)


@pytest.mark.parametrize("common", [url_filter.COMMON, 3, 10**9])
def test_verdicts(spark, monkeypatch, common):
    monkeypatch.setattr(url_filter, "COMMON", common)
    rng = np.random.default_rng(8)
    word = lambda letters: "".join(rng.choice(list(letters), int(rng.integers(2, 8))))
    urls = [f"http://{word('abcd')}.com/{word('abc')}?q={word('xyz')}" for _ in range(60)] + [f"http://{word('mnop')}.net/fr/{word('nop')}?s={word('123')}#{word('mn')}" for _ in range(60)]
    urls += [f"http://{word('abnm')}.org/{word('bn')}?q={word('xyz1')}" for _ in range(40)] + ["http://same.org/p?q=xyzzy", "http://same.org/p?s=123123#mn", None, "", "none", "é://漢.org/😀?😀"] + ["http://hot.org/a"] * 200
    rows = [*enumerate(urls), (3, None), (None, "http://hot.org/a")]
    frame = spark.createDataFrame([(i, u, "h", "p", "r", 1, "s", "t") for i, u in rows], SCHEMA)
    got = sorted(((r["page_id"], r["verdict"], round(r["score"], 9)) for r in url_filter.judged(frame).collect()), key=repr)
    want = brute(rows)
    assert [(g, w) for g, w in zip(got, want, strict=True) if g[:2] != w[:2] or abs(g[2] - w[2]) > 1e-7][:5] == []
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-7)
    same = {u: r["score"] for u, r in zip(urls, sorted(url_filter.judged(frame.where("page_id < 1000")).collect(), key=lambda r: r["page_id"]), strict=False)}
    assert same["http://same.org/p?q=xyzzy"] > same["http://same.org/p?s=123123#mn"]
