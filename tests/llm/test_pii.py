import random

import brute
from tidemark.llm import pii

TEXTS = [
    *brute.ODD_TEXTS,
    "a@b.c_d@e.f x.y+z@mail-1.example.com. é@x.y b@c",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0004 1.1.1 99999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 49927398716000000000000 4111  1111",
    "+1 (555) 123-4567 +44 20 7946 0958x +1 +123456789012345678 ++1 2 3 4 5 6 7 8 9 0",
    "1" * 5000 + "@" + "b" * 50 + ".c" * 2000,
    "éé 4111111111111111 ñ +49 30 1234 5678 a@b.cc 10.0.0.1 DE89370400440532013000 iban GB29 NWBK 6016 1331 9268 19",
    "DE89370400440532013001 phone 555-123-4567, lonely 555-123-4567",
]


def test_equals_brute_force(spark):
    rng = random.Random(5)
    parts = ["@", ".", "+", "-", " ", "(", ")", "1", "23", "4111111111111111", "a", "é", "255", "0", "b.c", "x@y.z", "+1 555 123 4567"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
    got = {r.doc_id: r for r in pii.op9(spark, brute.with_more_columns(brute.documents(spark, texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.pii(t), t
        base = [x for x in r.spans.split(",") if x.split(":")[0] in pii.BASE_KINDS] if r.spans else []
        assert brute.sha(",".join(base)) == r.base_sha256


def test_method_adds_spans(spark):
    got = [r.spans for r in pii.op9(spark, brute.documents(spark, TEXTS[-2:])).orderBy("doc_id").collect()]
    ibans = [x.split(":") for x in got[0].split(",") if x.startswith("iban")]
    assert [TEXTS[-2][int(s) : int(e)] for _, s, e in ibans] == ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"]
    assert got[1] == "national_phone:29:41"  # "phone" speaks for the number after it, not for the lonely one


def test_secrets_and_social_security_numbers(spark):
    aws, hub, slack, head = "AKIA" + "Z7" * 8, "ghp_" + "a1" * 18, "xoxb-" + "12-ab" * 3, "-----BEGIN RSA PRIVATE KEY-----"
    texts = [f"é {aws}, {hub};{slack} {head}", aws[:-1], hub[:-1], "xoxb-short", "-----BEGIN PUBLIC KEY-----"]
    texts += ["SSN: 123-45-6789, 123-45-6789", "ssn 1123-45-6789", "ssn 123-45-67890", "ssn 666-45-6789", "social security 123-00-6789", "sku 123-45-6789"]
    want = [[aws, hub, slack, head], [], [], [], [], ["123-45-6789"], [], [], [], [], []]
    for r in pii.op9(spark, brute.documents(spark, texts)).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        found = [texts[r.doc_id][int(s) : int(e)] for k, s, e in spans if k in ("ssn", "secret")]
        assert found == want[r.doc_id] and r.n_ssn + r.n_secret == len(found) and r.n_spans == len(spans)


def test_account_numbers_hide_no_others(spark):
    de, gb, hr, mt = "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "HR1210010051863000160", "MT84MALT011000012345MTLCAST001S"
    texts = [f"{de} {gb}", f"AB12 {gb} {de}", f"AT12 {de}", f"{de[:-1]}1 {gb}", f"{hr} {mt}", f"é{gb}{de}X", "HR1210010051863000161"]
    want = [[de, gb], [gb, de], [de], [gb], [hr, mt], [gb, de], []]
    for r in pii.op9(spark, brute.documents(spark, texts)).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x.startswith("iban")]
        assert [texts[r.doc_id][int(s) : int(e)] for _, s, e in spans] == want[r.doc_id] and r.n_iban == len(want[r.doc_id])


def test_sql_agrees(spark):
    import duckdb
    import pandas as pd

    de, gb, hr = "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "HR1210010051863000160"
    texts = [t for t in TEXTS if t is None or "\0" not in t] + [f"{de} {gb}", f"AB12 {gb} iban {de}", f"é{gb}{de}X konto {hr}", f"tel 555-123-4567, 555-123-4567 {hr}"]
    texts += ["ssn 123-45-6789, 123-45-6789-0 token AKIA" + "Z7" * 8, "é ssn 000-45-6789 xoxb-" + "12-ab" * 3 + " -----BEGIN PRIVATE KEY-----"]
    documents = pd.DataFrame({"doc_id": [0, *range(len(texts) - 1)], "text": texts})  # noqa: F841 (read by duckdb)
    want = duckdb.sql(pii.oracle()).df()
    docs = brute.documents(spark, texts, ids=documents["doc_id"].tolist())
    got = pii.op9(spark, docs).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert rows(got) == rows(want) and got["n_iban"].sum() == 10


def test_very_long_text(spark):
    """Its cost is about its length, however many matches it has."""
    text = "mail é a@b.cc 4111111111111111; 10.0.0.1, +49 30 1234 5678; DE89370400440532013000 " * 12_000
    r = pii.op9(spark, brute.documents(spark, [text])).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_iban) == (12_000,) * 5
    at = len(text) // 12_000 * 11_999 + text.index("a@b")
    assert f"email:{at}:{at + 6}," in r.spans


def test_empty_table(spark):
    assert pii.op9(spark, brute.documents(spark, [])).collect() == []
