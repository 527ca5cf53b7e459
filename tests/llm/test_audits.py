"""Filter audit, personal data and source divergence against plain twins, with the edge cases of their docstrings."""

import collections
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyfix.llm import divergence, filteraudit, langid, media, pii, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, n int, spans string, term string"


def docs_of(spark, rows):
    """doc_id, text, lang, source, and extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y", "z") for r in rows], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def audit_rows():
    long = " ".join(f"w{i % 150}" for i in range(260))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, long, None, "a"), (4, long, "", "b"), (4, long, "", "b"), (None, long, "fr", None), (None, None, "fr", "b")]
    rows += [(5, "LOUD " * 300, "en", "a"), (6, "Aa b #", "fr", "a"), (7, "Aa b #", "de", "a"), (8, long + " $", "en", "a"), (9, long.upper(), "en", None), (10, "é É x" * 90, "fr", "a"), (3, long, "en", "c")]
    rows += [(20 + i, "copy of a copy", "en" if i % 3 else None, "a") for i in range(60)]
    return rows


def plain_audit(rows, marks):
    def fails(i, text):
        t, w = text or "", words_of(text)
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u, *_ in rows)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), smaller)
        return {x for x, failed in zip("ABCDE", tests, strict=True) if failed}

    docs, out = [(lang or "", fails(i, t), i) for i, t, lang, _ in rows], {}
    for part in {p for p, *_ in docs}:
        own, shares = [(f, i) for p, f, i in docs if p == part], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order):
                gone = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                shares[letter] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(letter in f for f, _ in own) - len(gone), sum(f == {letter} for f, _ in own), *(sum(i in m for _, i in gone) for m in marks), letter]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shares[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_matches_plain_orders(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 1), (3, 1, 0), (5, 0, 1), (21, 1, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filteraudit.audit(docs_of(spark, audit_rows()), labels).collect()}
    assert got == plain_audit(audit_rows(), ({1, 3, 21}, {3, 5, 21}))
    assert len(got) == 4 * 600


def test_filter_audit_of_nothing_and_of_other_filters(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(docs_of(spark, []), labels).collect() == []
    rows = filteraudit.audit(docs_of(spark, audit_rows()), labels, {"s": lambda t: t.rlike("a")}, "=").collect()
    assert {r["filter_order"] for r in rows} == {"s=", "=s"} and all(r["good_lost"] == 0 for r in rows)
    with pytest.raises(ValueError):
        filteraudit.audit(docs_of(spark, []), labels, {"E": lambda t: t.rlike("a")}, "E")


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    def luhn(d):
        twice = [2 * int(c) if i % 2 else int(c) for i, c in enumerate(d[::-1])]
        return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0

    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z9", "@", ".", "-", " ", "+", "(", ")", "1", "25", "255", "256", "4111111111111111", "4111 1111 1111 1111", "é", "_", "%", "\n", "a@b.c", "1.2.3.4", "+1 555 123 4567"]), max_size=30).map("".join))
def test_base_spans_are_the_plain_patterns(text):
    assert [x[:3] for x in pii.find(text) if x[3]] == plain_base(text)


DISGUISED = [
    ("email", "john [at] example [dot] com"), ("email", "jane.doe(at)example.org"), ("email", "john dot doe at mail dot example dot com"), ("email", "ann&#64;example&#46;net"), ("email", "jоhn@ехample.com"),
    ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("email", "jo​hn@example.com"), ("email", "lea arobase exemple.fr"), ("email", "max @ beispiel . de"), ("ip", "one nine two dot one six eight dot one dot one"),
    ("ip", "１９２.168.1.20"), ("card", "four one one one one one one one one one one one one one one one"), ("card", "4111–1111–1111–1111"), ("phone", "plus one four one five five five five one two three four"),
    ("phone", "plus drei drei eins zwei drei vier fünf sechs sieben"), ("phone", "+٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨"), ("phone", "+1 four one five five five five one two three four"), ("email", "bob{at}corp{dot}io"),
]
HARMLESS = ["we met at noon and sat at the table", "a polka dot dress", "5 @ 3.50 each", "see (the) list [1] <a>", "one two three four five six seven eight nine", "one, two, three", "version 1.2.3 of 2024", "à bientôt – peut-être", "the dot at the end", "null eins zwei"]


def test_disguised_spans_lead_back_to_the_source(spark):
    rows, wanted = [], {}
    for i in range(len(DISGUISED) * 3):
        pieces, spans, at = [], [], 0
        for j in range(5):
            harmless = HARMLESS[(i + 3 * j) % len(HARMLESS)] + "; "
            kind, form = DISGUISED[(i + 7 * j) % len(DISGUISED)]
            spans.append((kind, at + len(harmless), at + len(harmless) + len(form)))
            pieces += (harmless, form, "; ")
            at += len(harmless) + len(form) + 2
        rows.append((i, "".join(pieces), "en", "a"))
        wanted[i] = {*spans, *plain_base(rows[-1][1])}  # a base pattern may stand inside a disguise
    for r in pii.scan(docs_of(spark, rows)).collect():
        assert sorted((s["kind"], s["start"], s["end"]) for s in r["spans"]) == sorted(wanted[r["doc_id"]]), rows[r["doc_id"]][1]
    assert all(not pii.find("; ".join(p)) for p in itertools.permutations(HARMLESS, 2))


def test_personal_data_edge_cases(spark):
    long = "lorem " * 200_000
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, long + "x@y.zz" + long, "en", "a"), (3, long, "en", "a"), (4, "1" * 300_000 + "." * 1000 + "a" * 300_000, "en", "a"), (5, "+1 555 123 4567 a@b.co", "en", "a")]
    docs = docs_of(spark, rows)
    got = sorted((r["doc_id"], [(s["kind"], s["start"], s["base"]) for s in r["spans"]]) for r in pii.scan(docs).collect())
    assert got == [(1, []), (2, []), (3, []), (3, [("email", len(long), True)]), (4, []), (5, [("email", 16, True), ("phone", 0, True)])]
    masked = {r["doc_id"]: r for r in pii.redact(docs.filter("doc_id in (1, 5)")).collect()}
    assert masked[5]["text"] == "[PHONE] [EMAIL]" and masked[1]["text"] is None and masked[5]["spans"] == "y"
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'ff61406279612E636F6D' AS string) AS text")
    assert [len(r["spans"]) for r in pii.scan(broken).collect()] == [1]


def test_personal_data_query(spark):
    out = queries.op12_pii(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    import hashlib

    for r in out:
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(","))
    assert len(out) == len(texts)


def plain_divergence(rows):
    docs = [(lang or "", source or "", [w for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]) for _, t, lang, source in rows]
    out = set()
    for lang in {x for x, *_ in docs}:
        seen = collections.Counter(w for x, _, ws in docs if x == lang for w in set(ws))
        kept = sorted(w for w, n in seen.items() if n >= 3)
        counts = {s: collections.Counter(w for x, y, ws in docs if (x, y) == (lang, s) for w in ws if w in kept) for s in {y for x, y, _ in docs if x == lang}}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), collections.Counter()))
        far = lambda a, b, w: (a[w] - b[w]) ** 2 // b[w]
        for s in counts:
            pairs = [(-sum(far(p[s], p[o], w) for w in kept), o.encode()) for o in counts if o != s]
            terms = [(-far(p[s], q, w), w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", sorted(terms)[:200])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(items))}
    return out


def test_divergence_matches_plain_counts(spark):
    rows = [(i, " ".join(f"{'Été' if j % 5 == 0 else 'Term'}{chr(97 + (i * j) % 23)}{chr(97 + j % 26)}_{j}" for j in range(i % 40)), "en" if i % 3 else "fr", f"s{i % 7}" if i % 11 else None) for i in range(120)]
    rows += [(1, "lonely", "xx", "a"), (1, "word", "xx", "b"), (2, None, None, None), (2, None, None, "z"), (3, "only only", "yy", "a"), (3, "only ONLY", "yy", "a"), (4, "oNly", "yy", "a")]
    rows += [(5, "q" * 5_000, "zz", "é"), (6, "q" * 5_000 + " 1 b", "zz", "z"), (7, "q" * 5_000 + "2b", "zz", None)]
    got = [tuple(r) for r in divergence.divergence(docs_of(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows)
    assert divergence.divergence(docs_of(spark, [])).collect() == []


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 64)
    monkeypatch.setattr(divergence, "ENTRIES", 40)
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i % 17)}" for i in range(5_000)) + " " + "x" * 500
    whole = sum((collections.Counter(p) for p in divergence._pieces(text.encode())), collections.Counter())
    assert whole == collections.Counter(w.encode() for w in text.split())
    rows = [(i, text, "en", f"s{i}") for i in range(4)] + [(9, "aa", "en", "s9")]
    assert {tuple(r) for r in divergence.divergence(docs_of(spark, rows)).collect()} == plain_divergence(rows)


def plain_grams(text):
    counts = collections.Counter()
    for word in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower())):
        c = [1, *map(ord, word), 1]
        counts.update(c[1:-1])
        counts.update(a << 21 | b for a, b in itertools.pairwise(c))
        counts.update((a << 21 | b) << 21 | d for a, b, d in zip(c, c[1:], c[2:], strict=False))
    return counts


def first_ranks(counts, top):
    return {g: i for i, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top])}


def plain_languages(rows, learned, top):
    sums = collections.defaultdict(collections.Counter)
    for _, text, lang, _ in learned:
        if text is not None and lang is not None:
            sums[lang].update(plain_grams(text))
    profiles = {lang: first_ranks(c, top) for lang, c in sorted(sums.items()) if c}
    out = []
    for i, text, _, _ in rows:
        own = first_ranks(plain_grams(text), top)
        far = sorted((sum(abs(p[g] - r) if g in p else top for g, r in own.items()), lang) for lang, p in profiles.items())
        best = (far[1][0] - far[0][0]) / max(far[1][0], 1) if len(far) > 1 else 1 - far[0][0] / max(len(own) * top, 1) if far else 0
        out.append((i, far[0][1], round(min(1, max(0, best)), 9)) if own and far else (i, "und", 0.0))
    return sorted(out, key=repr)


@pytest.mark.parametrize("top", [12, 400])
def test_languages_match_plain_profiles(spark, top):
    rows = [(i, " ".join(f"{'aeiou'[(i * j) % 5]}{chr(97 + (i + j * j) % 26)}{'ßéñ'[j % 3] if i % 4 == j % 4 else 'x'}" for j in range(i % 30)), ("de", "en", "fr", "pt", None)[i % 5], "s") for i in range(90)]
    rows += [(200, None, "en", "s"), (201, "", "de", None), (202, "123 !?", None, "s"), (7, rows[7][1], "fr", "s"), (7, rows[7][1], "fr", "s"), (203, "Straße İSTANBUL", None, None), (204, "abc", "aa", "s"), (205, "abc", "ab", "s"), (206, "abc", None, "s")]
    rows += [(300 + i, f"word{chr(97 + i % 26)}", f"lang{i:03d}", "s") for i in range(120)]
    profiles = langid.learn(docs_of(spark, rows), top)
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(docs_of(spark, rows), profiles, top).collect()), key=repr)
    assert got == plain_languages(rows, rows, top)


def test_many_languages_take_room_for_what_they_have():
    rows = [(f"l{i}", 10 * i + k, k) for i in range(3_000) for k in range(10)]
    profiles = langid.Profiles(rows, 400)
    assert len(profiles.rank) == 30_000 and sum(x.nbytes for x in (profiles.rank, profiles.lang, profiles.codes, profiles.first)) < 2_000_000


def test_media_that_is_null_or_cut_gives_nulls(spark):
    stored = [r.media for r in media.encode_media(spark.createDataFrame([(1, "some text " * 200)], "doc_id long, text string")).collect()][0]
    rows = [(1, 5, stored), (2, None, None), (3, 5, stored[: len(stored) // 2]), (4, 5, bytearray(b"no image")), (5, 5, stored[:-2]), (5, 5, stored)]
    frame = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    got = sorted(((r.doc_id, r.payload_sha256 is not None, r.media_bytes, r.feature is not None) for r in media.media_digest(frame).collect()), key=repr)
    n = len(stored)
    assert got == [(1, True, n, True), (2, False, None, False), (3, False, n // 2, False), (4, False, 8, False), (5, False, n - 2, False), (5, True, n, True)]
    tensors = sorted(((r.doc_id, r.rgb is not None) for r in media.rgb_tensors(frame).collect()))
    assert tensors == [(1, True), (2, False), (3, False), (4, False), (5, False), (5, True)]
