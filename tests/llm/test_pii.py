import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from evigraph.llm import pii

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits(v):
    return "".join(c for c in v if c in "0123456789")


def valid(kind, v):
    d = digits(v)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    return [(m.start(), KINDS.index(k), m.end(), k) for k, r in BASE.items() for m in re.finditer(r, text) if valid(k, m.group())]


def plausible(kind, v):
    d = digits(v)
    if kind == "email":
        return bool(re.fullmatch("[^@]+@[^@]+", v))
    if kind == "ip":
        six = ("::" in v or v.count(":") >= 7) and re.fullmatch(r"[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}", v)
        return bool(six) or bool(re.fullmatch(r"\d+(\.\d+){3}", v, re.A) and all(int(x) <= 255 for x in v.split(".")))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9][0-9 -]*", v)) and 12 <= len(d) <= 19 and luhn(d)
    return bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*", v)) and 9 <= len(d) <= 15


def runs(text):
    """Lists of (start, word): words with a digit or @, and words of brackets, dots and hyphens after one of these, parted by spaces alone."""
    words = [(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, open_ = [], False
    for k, (at, w) in enumerate(words):
        own = any(c in "0123456789@" for c in w)
        joined = open_ and re.fullmatch(" +", text[words[k - 1][0] + len(words[k - 1][1]) : at])
        if joined and (own or set(w) <= set("().-")):
            out[-1].append((at, w))
        elif own:
            out.append([(at, w)])
            open_ = True
        else:
            open_ = False
    return out


def mentions(text):
    """(start, end, kind or None, value, two words before, word after)."""
    found, have = [], base(text)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    for run in runs(text):
        a, b = run[0][0], run[-1][0] + len(run[-1][1])
        before, after = words(text[:a])[-2:], words(text[b:])[:1]
        for k in KINDS:
            at = a
            hits = [m for m in re.finditer(BASE[k], text[a:b])]
            for i, m in enumerate(hits):
                gap, nxt = text[at : a + m.start()], text[a + m.end() : a + hits[i + 1].start() if i + 1 < len(hits) else b]
                left = (before if i == 0 else []) + words(gap)[-2:]
                if valid(k, m.group()):
                    found.append((a + m.start(), a + m.end(), k, m.group(), left[-2:], (words(nxt) or after)[:1]))
                at = a + m.end()
        for i in range(len(run)):
            for n in range(1, min(4, len(run) - i) + 1):
                own = [w for _, w in run[i : i + n]]
                core = re.sub(r"^[^+(\w]+|^[_]+", "", own[0])
                while core and not (core[0].isalnum() or core[0] in "+("):
                    core = core[1:]
                head = len(own[0]) - len(core)
                tail = len(own[-1])
                while tail and not own[-1][tail - 1].isalnum():
                    tail -= 1
                start, end = run[i][0] + head, run[i + n - 1][0] + tail
                joined = " ".join(own)
                value = joined[head : len(joined) - (len(own[-1]) - tail)]
                if 0 < end - start <= 100 and any(c in "0123456789@" for c in value) and not any(x[0] < end and start < x[2] for x in have):
                    left = before[: 2 if i < 2 else 0] + [w for _, w in run[max(0, i - 2) : i]]
                    found.append((start, end, None, value, left[-2:], [run[i + n][1]] if i + n < len(run) else after))
    return found


def patterns(value, left, right):
    fold = lambda d: re.sub(r"[^\W\d_]+", "a", re.sub(d, "9", value))
    left, right = [w.lower() for w in left], [w.lower() for w in right]
    out = [f"shape {fold('[0-9]')}"]
    if left:
        out.append(f"after {left[-1]} {fold('[0-9]+')}")
    if right:
        out.append(f"before {right[0]} {fold('[0-9]+')}")
    if len(left) > 1:
        out.append(f"behind {' '.join(left)}")
    if left and right:
        out.append(f"between {left[-1]} {right[0]}")
    return out


def brute(rows, least=3, confident=0.8, rounds=3):
    own = [(i, t or "", mentions(t or "")) for i, t in rows]
    pairs = {(p, m[3]) for _, _, ms in own for m in ms if len(m[3]) <= 100 for p in patterns(*m[3:])}
    seeds = {}
    for _, _, ms in own:
        for m in ms:
            if m[2] and (m[3] not in seeds or KINDS.index(m[2]) < KINDS.index(seeds[m[3]])):
                seeds[m[3]] = m[2]
    by = {}
    for p, v in pairs:
        by.setdefault(p, []).append(v)
    for _ in range(rounds):
        sure = [(p, k, s / (len(vs) + 0.5)) for p, vs in by.items() for k in KINDS if (s := sum(seeds.get(v) == k for v in vs)) >= least and s / (len(vs) + 0.5) >= confident]
        miss = {}
        for p, k, c in sure:
            for v in by[p]:
                miss[v, k] = miss.get((v, k), 1.0) * (1 - c)
        new = {}
        for (v, k), m in miss.items():
            if v not in seeds and 1 - m >= confident and plausible(k, v):
                new[v] = max(new.get(v, (0, 0)), (1 - m, -KINDS.index(k)))
        if not new:
            break
        seeds |= {v: KINDS[-k] for v, (_, k) in new.items()}
    out = []
    for i, t, ms in own:
        extra, taken = [], -1
        for start, _, end, k in sorted({(m[0], -m[1], m[1], seeds[m[3]]) for m in ms if m[2] is None and m[3] in seeds}, key=lambda x: (x[0], x[1], x[3])):
            if taken <= start:
                extra.append((start, KINDS.index(k), end, k))
            taken = max(taken, end)
        mine = sorted(base(t))
        text = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        out.append((i, *(sum(x[3] == k for x in mine) for k in KINDS), sha256(text(mine).encode()).hexdigest(), text(mine + extra)))
    return sorted(out, key=repr)


def result(docs):
    return sorted(map(tuple, pii.digest(pii.personal_data(docs)).collect()), key=repr)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = pii.digest(pii.personal_data(docs))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


FUSED = ["5105105105105100", "4111111111111111", "4012888888881881", "5555555555554444"]


@pytest.fixture(scope="module")
def planted(spark):
    """Seeds in sentences, the same kinds in forms that the expressions miss, and numbers that are nothing."""
    rows = [(i, f"please call me at +1 (555) 010-{1000 + i} today. paid with {c} and mailed a{i}.b@mail{i}.example.org") for i, c in enumerate(FUSED)]
    rows += [(30 + i, f"reach the host at 10.0.{i}.7 now; call me at +1 (555) 020-{2000 + i} today") for i in range(20)]
    rows += [(20, "call me at (555) 030-3000 today"), (21, "reach the host at 2001:db8::17 now"), (22, "4111111111111111 378282246310005x 4012888888881881")]
    rows += [(23, "noise +1 (555) 040-4000 5105105105105100 noise"), (24, "paid with 4222222222222220000 and 4.0 2.0 items of 2024-01-02"), (25, "5555555555554444 5555555555554444")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_unseen_identifiers(planted):
    """What stands side by side, a phone number without its plus and an address of version 6 are found; other numbers are not."""
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.personal_data(planted)).collect()}
    assert got[23] == "phone:6:23,card:24:40" and got[25] == "card:0:16,card:17:33"
    assert got[20] == "phone:11:25" and got[21] == "ip:18:30"
    assert got[24] == ""
    rows = [(r["doc_id"], r["text"]) for r in planted.collect()]
    assert result(planted) == brute(rows)


def test_expressions_at_their_edges(spark):
    texts = [
        "a@b.c_d@e.f", "a@b@c.d", "x@y", "x@y..z", "x@y.z.", "..a@-.b-", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.003.255", "1.2.3", "1..2.3.4",
        "4111 1111-1111 1111", "4111  1111 1111 1111", "4111111111111112", "0000 0000 0000", "+1 (5) - 55 . 123-4567", "+1\t555 123 4567", "+12345678", "+123456789", "++1 234567890 -",
        "mail:a@b.c,+49 30 1234567;1.1.1.1", "é🙂 a@b.c 🙂 +1 555 000 1111 ü", "x1.2.3.4y", "12 - 34 ( 56 ) 78 . 9", "@", "1", " 1 ", "1@", "a@1.1.1.1",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert result(docs) == brute(list(enumerate(texts)))


def test_odd_rows(odd):
    docs = odd.withColumn("kind", F.lit("email")).withColumn("value", F.lit("x")).withColumn("start", F.lit(1)).withColumn("_row", F.lit("r"))
    assert result(docs) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_no_rows(none):
    assert result(none) == []


def test_very_long_texts(spark):
    """Long words, many short groups, many numbers: time stays linear and the stack flat."""
    texts = ["x" * 1_000_000, "1" * 1_000_000, "a@b" + ".c" * 300_000, "1." * 300_000, "+1" + " 2" * 300_000, "- " * 200_000 + "1 " + "- " * 200_000, "word 12 " * 30_000, "@" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r[0]: r[1:] for r in result(docs)}
    assert got[2][:4] == (1, 0, 0, 0) and got[3][1] == 75_000 and all(sum(got[i][:4]) == 0 for i in (0, 1, 4, 5, 6, 7))


def test_main_path_has_no_python(spark, tiny, capsys):
    pii.digest(pii.personal_data(spark.read.parquet(f"{tiny}/documents.parquet"))).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
