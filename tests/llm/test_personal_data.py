import hashlib
import re

from tickerloom.llm.personal_data import KINDS, personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if valid(k, m[0])]


ODD = ["", None, "a@b.c@d.e", "x a@b.c%q@d.e.f 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004", "4111 1111 1111 1111",
       "4111-1111-1111-1111-", "+1 (017) 555-7713 +", "é日本🎉 a.b@c.de 🎉 +4912345678901", "9" * 9000, "a" * 9000, "a@" * 500,
       "1." * 900, "+1" * 400 + "((((", "1 " * 2000, "4111111111111111 4111111111111112", "1.2.3.0000000255", "a@b..c",
       "99999999999999999999.1.1.1", "+" + "(" * 500 + "1", "٣٣٣٣٣٣٣ 1٣.1.1.1", "w " * 60_000 + "q@w.e"]


def test_base_spans_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(ODD)] + [(None, "a@b.c", "s", 2), (1, None, "s", 3)],
                                 "doc_id long, text string, spans string, _row int")
    rows = personal_data(docs).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        want = base("a@b.c" if r.doc_id is None else ODD[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in KINDS]
        assert r.spans == ",".join(want)
    assert personal_data(docs.limit(0)).count() == 0


def test_trusted_context_finds_unseen_identifiers(spark):
    def card(k):
        body = f"41111111{k:07d}"
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    texts = [f"pay with card number: {card(k * 7919)} today" for k in range(30)]
    texts += ["pay with card number: 4111111111111112 today", "serial 4111111111111112 of a part"]
    texts += [f"serial {1234567812345000 + k} of a part" for k in range(30) if not luhn(str(1234567812345000 + k))]
    rows = {r.doc_id: r for r in personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[30].spans == "card:22:38" and rows[30].n_card == 0
    assert rows[31].spans == "" and all(rows[i].spans == "" for i in range(32, len(texts)))
    assert all(rows[i].spans == "card:22:38" for i in range(30))


def test_many_matches_in_one_text(spark):
    log = " ".join(f"10.{i % 256}.{i // 256 % 256}.{i % 7} a{i}@b.c" for i in range(4000))
    docs = spark.createDataFrame([(1, log)], "doc_id long, text string")
    row = personal_data(docs).collect()[0]
    want = base(log)
    assert (row.n_email, row.n_ip) == (4000, 4000)
    assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
