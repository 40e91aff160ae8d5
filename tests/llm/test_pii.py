import hashlib
import random
import re

from helpers import docs, folder, same, texts

from menurank.llm import pii

# The contract's patterns, as it writes them.
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out, n = [], []
    for k, (kind, pattern) in enumerate(BASE.items()):
        own = []
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                own.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        out += own
        n.append(len(own))
    listed = ",".join(x for _, _, x in sorted(out))
    return (*n, hashlib.sha256(listed.encode()).hexdigest()), listed


def test_base_spans(spark, tmp_path):
    rng = random.Random(2)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    kinds = [lambda: some("ab.@_+-%é1 ", 14), lambda: ".".join(rng.choice(["0", "12", "255", "256", "001", "00000"]) for _ in range(rng.randrange(1, 7))), lambda: some("0123456789 -", 26), lambda: "+" + some("0123456789 ().-+", 20), lambda: "4111 1111 1111 1111", lambda: "a@b.co", lambda: "😀 x"]
    rows = [(100 + i, "".join(rng.choice(kinds)() for _ in range(rng.randrange(1, 12)))) for i in range(1500)]
    rows += texts() + [(5001, "1" * 20000 + " a" + "1 2-" * 5000), (5002, "a" * 60000 + "@" + "b." * 5000), (5003, "a.b" * 20000), (5004, "1.2.3.4." * 3000)]
    got = pii.op9_pii(spark, folder(spark, tmp_path, rows)).collect()
    assert same([(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got], [(i, *brute(t)[0]) for i, t in rows])
    by = {i: brute(t)[1] for i, t in rows if i is not None}
    assert all(set(filter(None, by[r["doc_id"]].split(","))) <= set(r["spans"].split(",")) for r in got if r["doc_id"] is not None and r["doc_id"] != 1)


def test_terms_that_disclose_an_entity(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    fill = lambda n: " ".join(["the", *(word() for _ in range(n)), "and"])
    rows = [(i, f"{fill(9)} the zanzibarian jo@secret.org the {fill(5)}") for i in range(6)]
    rows += [(20 + i, f"the {fill(9)} mail u{i}@other{i}.org the {fill(5)}") for i in range(60)] + [(100 + i, fill(12)) for i in range(60)]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.op9_pii(spark, folder(spark, tmp_path, rows)).collect()}
    for i, text in rows:
        terms = {text[int(s) : int(e)] for kind, s, e in (x.split(":") for x in got[i] if x) if kind == "term"}
        assert terms == ({"zanzibarian"} if i < 6 else set())
    safe = {r["doc_id"]: r["text"] for r in pii.sanitised(docs(spark, rows)).collect()}
    assert "the [TERM] [EMAIL] the" in safe[0] and "[EMAIL]" in safe[20] and safe[100] == dict(rows)[100]


def test_terms_that_disclose_what_values_seen_once_share(spark, tmp_path):
    """Each value is in one text only; its domain, network, issuer or area is in six."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    fill = lambda n: " ".join(["the", *(word() for _ in range(n)), "and"])
    cards = [c for c in (f"411111{n:010d}" for n in range(10**9, 10**9 + 100)) if luhn(c)]
    said = {"zanzibarian": lambda i: f"jo{i}@secret.org", "quuxnetwork": lambda i: f"10.20.30.{i}", "goldenbank": lambda i: cards[i], "lakesidetown": lambda i: f"+1 (323) 555-10{i:02d}"}
    rows = [(100 * n + i, f"{fill(9)} the {term} {value(i)} the {fill(5)}") for n, (term, value) in enumerate(said.items()) for i in range(6)]
    rows += [(1000 + i, fill(12)) for i in range(200)]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.op9_pii(spark, folder(spark, tmp_path, rows)).collect()}
    for i, text in rows:
        terms = {text[int(s) : int(e)] for kind, s, e in (x.split(":") for x in got[i] if x) if kind == "term"}
        assert terms == ({list(said)[i // 100]} if i < 1000 else set())


def test_terms_far_from_the_value_and_in_other_texts(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    fill = lambda n: " ".join(["the", *(word() for _ in range(n)), "and"])
    rows = [(i, f"İ😀 Zanzibarian, {fill(40)} jo@secret.org {fill(40)} (ZANZIBARIAN) zanzibarian{word()}") for i in range(6)]
    rows += [(20, f"{fill(5)} zanzibarian alone"), (21, f"{fill(5)} zanzibarian alone"), (21, None)] + [(100 + i, fill(12)) for i in range(200)]
    got = pii.op9_pii(spark, folder(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    spans = {r["doc_id"]: r["spans"].split(",") for r in got if r["doc_id"] != 21}
    for i, text in rows:
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"\b[Zz](?:anzibarian|ANZIBARIAN)\b", text or "")]
        assert i == 21 or [x for x in spans[i] if x.startswith("term")] == want
    safe = [r["text"] for r in pii.sanitised(docs(spark, rows)).collect()]
    assert len(safe) == len(rows) and not any(re.search(r"zanzibarian\b|secret", x or "", re.I) for x in safe) and sum((x or "").count("[TERM]") for x in safe) == 14


def test_sanitised_rows(spark):
    df = docs(spark)
    out = pii.sanitised(df)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == df.columns and out.count() == df.count()
    assert rows[3]["text"] is None and rows[12]["text"] == "mail [EMAIL] or [PHONE] now" and rows[12]["n_chars"] == len("mail [EMAIL] or [PHONE] now")
    assert pii.sanitised(docs(spark, [])).count() == 0


def test_no_python(spark, tmp_path):
    plan = pii.op9_pii(spark, folder(spark, tmp_path, [(1, "a@b.co")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_entities(text):
    """The value of each base span and its classes."""
    out = set()
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            if not brute(m.group())[1].startswith(f"{kind}:0:{len(m.group())}") and f"{kind}:0:{len(m.group())}" not in brute(m.group())[1].split(","):
                continue
            value = m.group().lower()
            number = re.sub("[^0-9]", "", value)
            if kind == "email":
                domain = value.split("@")[-1]
                parts = domain.split(".")
                classes = [value, domain, *(".".join(parts[-n:]) for n in (2, 3, 4))]
            elif kind == "ip":
                parts = value.split(".")
                classes = [value, *(".".join(parts[:n]) + "." for n in (1, 2, 3))]
            else:
                classes = [number, number[: 6 if kind == "card" else 4], number[:1]]
            out |= {f"{k}:{c}" for c in classes}
    return out


def plain_terms(rows):
    """All terms that disclose an entity, by counting every pair over all distinct texts."""
    import math
    from collections import Counter

    every = {}
    for t in {t or "" for _, t in rows}:
        blank = list(t)
        for x in filter(None, brute(t)[1].split(",")):
            _, s, e = x.split(":")
            blank[int(s) : int(e)] = " " * (int(e) - int(s))
        runs = re.findall(r"[^\W\d_]{2,}", "".join(blank))
        every[t] = plain_entities(t), {w.lower() for w in runs}
    n = len(every)
    n_e, n_t = Counter(e for es, _ in every.values() for e in es), Counter(w for _, ws in every.values() for w in ws)
    both = Counter((w, e) for es, ws in every.values() for e in es for w in ws)
    return {w for (w, e), c in both.items() if c >= pii.SUPPORT and math.log2(n * c / (n_t[w] * n_e[e])) >= pii.THETA * math.log2(n / n_e[e]) - 1e-12}


def test_all_terms_as_counting_every_pair_finds_them(spark, tmp_path):
    rng = random.Random(6)
    names = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(80)]
    values = [lambda x: f"u{rng.randrange(9)}@mail{x}.org", lambda x: f"10.{x}.0.{rng.randrange(9)}", lambda x: f"+1 {300 + x} 555 01{rng.randrange(10)}{rng.randrange(3)}"]
    rows = []
    for i in range(400):
        topic = rng.randrange(12)
        words = [rng.choice(names[:40]) for _ in range(rng.randrange(3, 12))] + ([names[40 + topic]] if rng.random() < 0.7 else [])
        if rng.random() < 0.6:
            words += [values[topic % 3](topic), names[60 + topic]][: 1 + (rng.random() < 0.9 - 0.06 * topic)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1]) for i in range(60)] + [(2000, None), (2001, "")]  # copies count once
    want = plain_terms(rows)
    assert 3 <= len(want) < 60
    got = {r["doc_id"]: r["spans"] for r in pii.op9_pii(spark, folder(spark, tmp_path, rows)).collect()}
    for i, t in rows:
        base = [x for x in brute(t)[1].split(",") if x]
        taken = [(int(s), int(e)) for _, s, e in (x.split(":") for x in base)]
        blank = "".join(" " if any(s <= k < e for s, e in taken) else c for k, c in enumerate(t or ""))
        terms = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{2,}", blank) if m.group().lower() in want]
        assert sorted(filter(None, got[i].split(","))) == sorted(base + terms)


def test_texts_are_matched_in_one_pass(spark, tmp_path):
    """The base patterns stand in the plan of the stored table only, not in that of the result."""
    rows = [(i, f"the zanzibarian jo@secret.org word{chr(97 + i)} is here") for i in range(6)] + [(50 + i, f"another text of{chr(97 + i % 26)} no value x{i}") for i in range(80)]
    out = pii.op9_pii(spark, folder(spark, tmp_path, rows))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.filter("spans like '%term:%'").count() == 6 and "A-Za-z0-9._%" not in plan
