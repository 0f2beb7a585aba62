import random

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import arbitrate as A
from pagewright.operators import decode, domains, entities, lexicon


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("r")).first()["r"]


def test_accents(spark):
    assert one(spark, "Đường Phố Huệ, 12", T.remove_accents("t")) == "Duong Pho Hue, 12"
    assert one(spark, "ế", T.remove_accents("t")) == "e"
    assert one(spark, None, T.remove_accents("t")) is None
    assert one(spark, "A - Cộng, 3.5", T.fold_key("t")) == "acong35"


def test_composed(spark):
    assert one(spark, "ế", T.nfc("t")) == "ế"
    assert one(spark, "plain", T.nfc("t")) == "plain"
    assert one(spark, None, T.nfc("t")) is None


def test_natural_order(spark):
    names = ["doc_10.png", "doc_1.png", "doc_2.png", "doc_20.png", "2a", "10a", "Doc_3.png", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key("n"), "n")
    assert [r[0] for r in df.collect()] == ["", "2a", "10a", "doc_1.png", "doc_2.png", "Doc_3.png", "doc_10.png", "doc_20.png"]


def test_peel_and_case(spark):
    r = one(spark, "(\"Hàng\").", T.peel("t"))
    assert (r["lead"], r["stem"], r["tail"]) == ('("', "Hàng", '").')
    df = spark.createDataFrame([("ABC", "hàng"), ("Abc", "hàng"), ("abc", "hàng")], "o string, w string")
    assert [x[0] for x in df.select(T.like_case(F.col("o"), F.col("w"))).collect()] == ["HÀNG", "Hàng", "hàng"]


def test_typography(spark):
    assert one(spark, "Số :12 ,giá:cao  ' x ~ y ", T.typography("t")) == "Số:12, giá: cao x y"


SHIELDED = "Kho Sếu Tràm nhận 7.450.000 đ theo đơn QX7-88AB ngày 3/9/2031, mã 9912345678, thẻ 123456789012, xem www.kho.test/a và https://kho.test/b hoặc hỏi ban_thu@kho.test"


def test_shield_round_trip(spark):
    df = spark.createDataFrame([(SHIELDED,), ("",), (None,), ("không có gì",)], "t string").select("t", entities.shield("t").alias("s"))
    rows = df.select("t", "s.*", entities.unshield(F.col("s.shielded"), F.col("s.saved")).alias("back")).collect()
    assert all(r["t"] == r["back"] for r in rows)
    hidden = rows[0]["shielded"]
    assert "__SHIELD_ENT_0__" in hidden
    assert not any(x in hidden for x in ("9912345678", "123456789012", "7.450.000", "QX7-88AB", "https", "@"))


def test_kinds(spark):
    kinds = {r["entity"]: r["kind"] for r in entities.entity_rows(spark.createDataFrame([(1, SHIELDED)], "id int, text string"), ["id"]).collect()}
    assert kinds["9912345678"] == "tax_id" and kinds["123456789012"] == "account" and kinds["QX7-88AB"] == "sku" and kinds["3/9/2031"] == "date"
    assert kinds["https://kho.test/b"] == "url" and kinds["www.kho.test/a"] == "www" and kinds["ban_thu@kho.test"] == "email" and "currency" in kinds.values()


def test_domains(spark):
    text = "Hóa đơn giá trị gia tăng tiền hàng thuế suất thanh toán xuất kho"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "key int, text string")
    scores = domains.domain_scores(df, ["key"])
    assert scores.where("key = 1 and domain = 'INVOICE_FINANCE'").first()["score"] > 5
    assert scores.where("key = 2").count() == 0
    words = spark.createDataFrame([(1, "đồng"), (1, "xyz")], "key int, word string")
    boost = {r["word"]: r["boost"] for r in domains.word_boost(words, scores, spark).collect()}
    assert boost["đồng"] == 3.5 and boost["xyz"] == 1.0


def test_stems(spark):
    assert {"dao", "đao"} <= set(one(spark, "clao", lexicon.candidate_stems(F.col("t"))))
    assert "cong" in one(spark, "c0ng", lexicon.candidate_stems(F.col("t")))


def test_context_score(spark):
    toks = spark.createDataFrame([(1, k, w) for k, w in enumerate("cộng hòa xã hội chủ".split())], "key int, pos int, token string")
    two = spark.createDataFrame([("hòa", "xã", 150), ("xã", "hội", 150)], "w1 string, w2 string, cnt int")
    three = spark.createDataFrame([("cộng", "hòa", "xã", 200), ("hòa", "xã", "hội", 200), ("xã", "hội", "chủ", 200)], "w1 string, w2 string, w3 string, cnt int")
    score = {r["token"]: r["score"] for r in lexicon.context_scores(toks, "key", two, three).collect()}
    assert score["xã"] == 1905


LEXICON = "kiểm tra toàn toán bộ chúc mừng năm mới thanh tiền hàng".split()


def model():
    pairs = [("kiểm", "tra"), ("tra", "toàn"), ("toàn", "bộ"), ("chúc", "mừng"), ("mừng", "năm"), ("năm", "mới"), ("thanh", "toán"), ("toán", "tiền"), ("tiền", "hàng")]
    return decode.Model(dict.fromkeys(LEXICON, 10), dict.fromkeys(pairs, 150), {})


def test_decode():
    m = model()
    assert m.decode("kiem tra toan bo", {}) == "kiểm tra toàn bộ"
    assert m.decode("chuc mung nam moi", {}) == "chúc mừng năm mới"
    assert m.decode("THANH TOAN Tien hang.", {}) == "THANH TOÁN Tiền hàng."
    assert m.decode("", {}) == ""


def test_correct(spark):
    df = spark.createDataFrame([(1, "kiem tra toan bo MST: 0311362549"), (2, None), (3, " "), (4, "So nha 5, uy ban nhan dan , Ha Noii")], "id int, text string")
    got = {r["id"]: r["corrected"] for r in decode.correct(df, ["id"], model(), places=["Hà Nội"]).collect()}
    assert got[1] == "kiểm tra toàn bộ MST: 0311362549"
    assert got[2] is None and got[3] == ""
    assert "ủy ban nhân dân" in got[4].lower()


def test_rules_expand_groups():
    rules = decode.compiled([(r"\bso\s+(\d+)", r"Số \1"), ("tong cong:?", "Tổng cộng:")])
    assert decode.apply_rules("so 12 tong cong", rules) == "Số 12 Tổng cộng"
    assert decode.apply_rules("TONG CONG:", rules) == "TỔNG CỘNG:"
    assert decode.lint_rules([("(", "x"), ("a", "b"), ("a", r"\1"), ("", "x")])
    assert not decode.lint_rules(decode.phrase_rules())


def test_gate_and_memo_change_nothing():
    rng = random.Random(4)
    words = "ghi chu Đơn gia THÀNH TIEN so luong tổng cong x phieu xuat kho kiêm  hoa don, nguoi nhan:".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    assert [decode.apply_rules(t, decode.compiled()) for t in texts] == [decode.apply_rules(t, decode.compiled(decode.phrase_rules())) for t in texts]
    m = model()
    for t in texts:
        assert m.decode(t, decode._boosts(t)) == m.decode(t, dict(decode._boosts(t)))


def test_correction_against_all_readings():
    """The chosen word is the one that scores best over all words of the lexicon and all forms of its neighbours, by the weights as stated."""
    rng = random.Random(11)
    lexicon_ = {w: rng.randint(1, 50) for w in ("hàng", "hang", "hạng", "kho", "khó", "khô", "xuất", "nhập", "nhấp", "đồng", "động", "dong")}
    names = sorted(lexicon_)
    b = {(rng.choice(names), rng.choice(names)): rng.randint(1, 200) for _ in range(60)}
    t = {(rng.choice(names), rng.choice(names), rng.choice(names)): rng.randint(1, 200) for _ in range(60)}
    m = decode.Model(lexicon_, b, t)
    same = lambda w: [w, *(x for x in names if x != w and decode.fold(x) == decode.fold(w))]
    for _ in range(400):
        p2, p1, n1, n2 = (rng.choice([None, *names]) for _ in range(4))
        token = decode.fold(rng.choice(names))
        if not (p1 or n1):
            continue

        def score(w, p1=p1, n1=n1, p2=p2, n2=n2):
            return max(1.5 * b.get((p, w), 0) + 1.2 * b.get((w, n), 0) + 2.5 * t.get((p2, p, w), 0) + 3.0 * t.get((p, w, n), 0) + 2.0 * t.get((w, n, n2), 0)
                       for p in (same(p1) if p1 else [None]) for n in (same(n1) if n1 else [None]))

        among = [w for w in names if w == token or decode.fold(w) in (token, token.replace("d", "đ"))]
        best = min(among, key=lambda w: (-score(w), -lexicon_[w], w))
        got = m.correct(token, p2, p1, n1, n2, {})
        if score(best) > score(token):
            assert got == best
        else:
            assert got == (token if token in lexicon_ else got)


def test_correction_by_joins_gives_the_same(spark):
    rng = random.Random(7)
    words = "hàng hang kho khó xuất nhập đồng động dong, (Kho) HANG cl0ng giao a@b.test 12/3/2030 GIAO rno".split()
    rows = [(k, "x", " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for k in range(60)] + [(90, "x", None), (91, "x", ""), (92, "x", "Kho hang, Ha Noi")]
    df = spark.createDataFrame(rows, "id int, w string, text string")
    lex, two, three = lexicon.lexicon(df), lexicon.ngrams(df, [], 2), lexicon.ngrams(df, [], 3)
    want = {r["id"]: r["corrected"] for r in decode.correct(df, ["id"], decode.load_model(lex, two, three), places=["Hà Nội"]).collect()}
    got = {r["id"]: r["corrected"] for r in decode.correct_by_joins(df, ["id"], lex, two, three, places=["Hà Nội"]).collect()}
    assert got == want and len(got) == 63


def test_place_ratio():
    assert decode.nearest_place("Ha Noi", ["Hà Nội", "Hà Nam"], 0.6) == "Hà Nội"
    assert decode.nearest_place("zzz", ["Hà Nội"]) is None


def test_arbitrate(spark):
    cases = [
        ("0106034111-001", 0.95, "0106034111-00l", 0.75, "0106034111-001", "paddleocr"),
        ("CONG TY TNHH MAI SONG NGUYEN", 0.91, "CÔNG TY TNHH MAI SONG NGUYÊN", 0.88, "CÔNG TY TNHH MAI SONG NGUYÊN", "cross_verified"),
        ("Hop dong kinh te", 0.80, "Hợp đồng kinh tế", 0.92, "Hợp đồng kinh tế", None),
        ("120000", 0.75, "1.200.000", 0.95, "1.200.000", "vietocr"),
        ("1.150.004", 0.70, "1.150.000", 0.95, "1.150.000", "vietocr"),
        ("Ngy:09/09/2026", 0.80, "Ngày: 09/09/2026", 0.85, "Ngày: 09/09/2026", None),
        (None, None, "", 0.3, "", "none"),
    ]
    df = spark.createDataFrame(cases, "p string, pc double, v string, vc double, want string, by string")
    for r in df.select("want", "by", A.arbitrate(F.col("p"), F.col("pc"), F.col("v"), F.col("vc")).alias("a")).collect():
        assert r["a"]["text"] == r["want"] and r["by"] in (None, r["a"]["winner"])
    assert df.where(A.mostly_digits(F.col("v"))).count() == 4
