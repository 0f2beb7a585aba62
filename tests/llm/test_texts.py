import random
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import addressing, leak, overlap, packing, personal, plainform, reading, scannoise

WORDS = addressing.PlaceWords({"vang", "que", "kha", "moc", "phieu", "lung"}, {"bach", "gia"})
NAMES = personal.Names([{"sam": 5.0, "cu": 4.0}, {"van": 2.0, "xuan": 3.0}, {"bang": 1.0, "lam": 3.0}])


# --- personal information


def found(text, field="full_text"):
    return [(i.kind, text[i.start : i.end]) for i in personal.find_items(text, NAMES, WORDS, field)]


def test_items():
    text = "Số phiếu: 0813867485\nMST: 9835679847-001\nÔng/Bà: Sầm Xuân Lâm\nGọi (+84) 951-586-545 hoặc 0217.3070.062, CCCD 099.237.508.238, thư a_b1 @x-y.test. Giờ"
    assert found(text) == [("person", "Sầm Xuân Lâm"), ("phone", "(+84) 951-586-545"), ("phone", "0217.3070.062"), ("id_number", "099.237.508.238"), ("email", "a_b1 @x-y.test")]
    assert found("Số tài khoản 731379831038, No. 689291, 1.553.500 đồng, 12/09/2029") == []
    assert found("holder of identity card 395410348 (CCCD Z1327481)") == [("id_number", "395410348"), ("id_number", "Z1327481")]
    assert found("Giao tại: 12 Bạch Thế Lâm, P.8, Vãng Quế") == [("address", "12 Bạch Thế Lâm, P.8, Vãng Quế")]
    assert found("Sau đó Sầm Xu-\nân Lâm ký") == [("person", "Sầm Xu-\nân Lâm")]
    assert found("Vãng Quế", "tinh_thanh") == [] and found("", "ho_ten") == [] and found("  ", "sdt") == []
    assert found(" Lý Thanh Hà ", "ho_ten") == [("person", "Lý Thanh Hà")] and found("không rõ", "ho_ten") == []


def test_names_of_two_to_four_words_and_unknown_words():
    assert found("Giao cho Sầm Lâm ký") == [("person", "Sầm Lâm")]
    assert found("gặp Cù Xuân Văn Bằng nhé") == [("person", "Cù Xuân Văn Bằng")]
    assert found("gặp Sầm Xuân Tró nhé") == [("person", "Sầm Xuân Tró")]
    assert found("Ông Zuy Tró đã ký. Người nhận: Bà Qua Văn Ơm") == [("person", "Zuy Tró"), ("person", "Qua Văn Ơm")]
    assert found("Zuy Tró đã ký, Sầm Tró") == []
    assert found("Sầm Văn Bằng  Tró") == [("person", "Sầm Văn Bằng")]
    assert found("Sầm Zuy Tró (kho)", "ho_ten") == [("person", "Sầm Zuy Tró")] and found("Tró Sầm Xuân", "ho_ten") == [("person", "Tró Sầm Xuân")]
    common = personal.Names([*NAMES.bits, {"cong": -9.0, "ty": -9.0}])
    assert personal.find_items("Người nhận: Công Ty Tró", common, WORDS) == []


def test_names_of_all_lengths_are_learned(spark):
    rows = [("cầm tay", {"ho_ten": n}) for n in ("Sầm Lâm", "Cù Văn Bằng", "Cù Xuân Văn Bằng")] * 2 + [("thùng " * 40, None)]
    bits = personal.learn_names(spark.createDataFrame(rows, "full_text string, extracted_fields map<string,string>"))
    assert [set(b) for b in bits[:3]] == [{"sam", "cu"}, {"van", "xuan"}, {"lam", "bang"}]
    assert bits[3]["thung"] < bits[3]["cam"] < 0


def test_fields_of_codes_are_read_too():
    assert found("gọi (+84) 951-586-545", "so_phieu") == [("phone", "(+84) 951-586-545")] and found("thư a@b.test", "mst") == [("email", "a@b.test")]
    assert found("0813867485", "so_phieu") == [] and found("TP. Sầm Xuân Lâm", "tinh_thanh") == [] and found("Sầm Xuân Lâm", "chuc_danh") == [("person", "Sầm Xuân Lâm")]


def test_contexts_are_learned_by_what_stands_beside_protected_numbers(spark):
    rows = [(k, f"xin goi 09510000{k:02d}, kho 09520000{k:02d}, ma 3954103{k:02d} va the 1954103{k:02d}", {"sdt": f"09510000{k:02d}", "cccd": f"1954103{k:02d}"}) for k in range(90)]
    df = spark.createDataFrame([*rows, (900, None, None), (901, "", {}), (902, "x", {"sdt": None})], "result_id bigint, full_text string, extracted_fields map<string,string>")
    drafted = personal.drafts(df, [{}] * 4, WORDS)
    contexts = personal.learn_contexts(drafted)
    text = "xin gọi 0951999999, kho 0952888888, mã 395410399 và thẻ 195410399"
    got = [(i.kind, text[i.start : i.end]) for i in personal.find_items(text, NAMES, WORDS, "full_text", contexts)]
    assert got == [("phone", "0951999999"), ("id_number", "195410399")]
    assert personal.learn_contexts(drafted.limit(0)) == {}


def test_mask():
    text = "Ông/Bà: Sầm Xuân Lâm, 0217.3070.062."
    items = personal.find_items(text, NAMES, WORDS)
    assert personal.masked(text, items) == "Ông/Bà: [PERSON], [PHONE]."
    assert personal.masked("x", []) == "x"


def test_scan_defined_for_nulls(spark):
    rows = [(1, "Gọi 0217.3070.062", {"sdt": "0951 586 545", "ghi_chu": None}, "x"), (2, None, None, "x"), (3, "", {}, "x"), (None, "0217.3070.062", None, "x"), (1, "Gọi 0217.3070.062", None, "x"),
            (4, "chữ " * 20000 + "0217.3070.062", None, "x")]
    df = spark.createDataFrame(rows, "result_id bigint, full_text string, extracted_fields map<string,string>, kind string")
    found = personal.scan(df, personal.learn_names(df), WORDS)
    got = found.select("result_id", "field_name", F.explode("items").alias("i")).select("result_id", "field_name", "i.kind", "i.start_pos")
    assert sorted(map(tuple, got.collect())) == [(1, "full_text", "phone", 5), (1, "full_text", "phone", 5), (1, "sdt", "phone", 1), (4, "full_text", "phone", 80001)]
    assert {(r["result_id"], r["field_name"], r["masked"][-12:]) for r in found.collect()} == {(1, "full_text", "Gọi [PHONE]"), (1, "sdt", "[PHONE]"), (4, "full_text", " chữ [PHONE]")}
    assert personal.scan(df.limit(0), [{}, {}, {}], WORDS).count() == 0


def test_mask_in_the_engine(spark):
    text = "Gọi 😀 Sầm Xuân Lâm, số 0217.3070.062, rồi Cù Văn Bằng"
    items = personal.find_items(text, NAMES, WORDS)
    rows = [(text, [(i.kind, i.start + 1, i.end) for i in items]), ("x", []), ("", [])]
    df = spark.createDataFrame(rows, "t string, i array<struct<kind:string,start_pos:int,end_pos:int>>")
    assert [r[0] for r in df.select(personal.mask(F.col("t"), F.col("i"))).collect()] == [personal.masked(text, items), "x", ""] and len(items) == 3


# --- scan noise


def test_repair_page():
    v = scannoise.Vocabulary(dict.fromkeys("hàng trong kho giao nhận kiểm tra phiếu người mới".split(), 50) | {"kiểrn": 1})
    units = ["BÁO CÁO KHO LŨNG 28 - CÔNG TY GIẤY", "PHIẾU GIAO", "n9ười nh-", "ận kiểrn tra |nàng", None, "8 giờ -", "17 giờ", "Trang 2/6"]
    text, spots = scannoise.repair_page(units, scannoise.Running(("baocaokholung28congtygiay",)), 1, v)
    assert spots == [(0, "header"), (2, "hyphen"), (2, "misread"), (3, "misread"), (7, "page_number")]
    assert "người nhận kiểm tra hàng" in text and "Trang" not in text and "BÁO CÁO" not in text
    assert scannoise.repair_page([], scannoise.Running(), None, v) == ("", []) and scannoise.repair_page([None, ""], scannoise.Running(), 0, v) == ("", [])
    assert scannoise.repair_page(["3"], scannoise.Running(), 0, v)[1] == [] and scannoise.repair_page(["3"], scannoise.Running(), 2, v)[1] == [(0, "page_number")]
    assert scannoise.repair_page(["KH92-6099 a@b.test 12.000"], scannoise.Running(), 0, v)[1] == []


def test_words_with_many_suspect_characters():
    v = scannoise.Vocabulary({"hhhhhhanh": 40, "ple": 9})
    assert v.repaired("|n|n|n|n|n|nanh") == "hhhhhhanh" and v.repaired("p13") is None and v.repaired("|n|n|n|n|n|nang") is None


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "result_id bigint, file_path string, page_index int, full_text string")


def lines_of(running):
    return {r["file_path"]: (r["heads"], r["feet"], r["offset"]) for r in running.collect()}


def test_heads_and_pages(spark):
    head = "SỔ GIAO NHẬN TỔNG HỢP - CÔNG TY"
    rows = [(k, "f", k, f"{head}\nPHIẾU BẢO HÀNH CHUNG\nx{k}") for k in range(3)] + [(10 + k, f"g{k}", j, f"PHIẾU BẢO HÀNH CHUNG\ny{k}" if j == 0 else "z") for k in range(9) for j in (0, 1)] + [(30, None, None, "z"), (31, "f", 3, None)]
    df = pages_of(spark, rows)
    pages = scannoise.text_pages(df)
    running, openers, words = scannoise.running_lines(pages)
    assert lines_of(running)["f"] == (["sogiaonhantonghopcongty"], [], 1)
    out = scannoise.repair(pages, running, scannoise.vocabulary(df), openers, words)
    spots = {(r["result_id"], s["pos"], s["kind"]) for r in out.collect() for s in r["spots"]}
    assert spots == {(k, 1, "header") for k in range(3)} and out.count() == 22
    boxes = spark.createDataFrame([(0, "f", k, t) for k, t in enumerate([head, None, "tro-", "ng kho"])] + [(99, "q", 5, "x")], "page_id bigint, file_path string, box_id int, text string")
    got = scannoise.repair(scannoise.box_pages(boxes, df), running, {"trong": 9})
    assert {(r["result_id"], s["pos"], s["kind"]) for r in got.collect() for s in r["spots"]} == {(0, 0, "header"), (0, 2, "hyphen")}
    assert scannoise.repair(pages.limit(0), running, {}).count() == 0 and scannoise.running_lines(pages.limit(0))[0].count() == 0


def test_feet_misread_heads_and_numbers_that_begin_elsewhere(spark):
    rng = random.Random(5)
    body = lambda: "".join(" ".join("".join(rng.choice("bcdghklmnt") + rng.choice("aeou") for _ in range(2)) for _ in range(5)) + "\n" for _ in range(3))
    heads = ["SỔ GIAO NHẬN HÀNG NĂM", "S0 GIAO NHẬN HÀNG NĂM", "SỔ GlAO NHẬN HÀNG NĂM", "SỔ GIAO NHẬNN HÀNG NĂM"]
    rows = [(k, "f", k, f"{heads[k]}\n{body()}Lưu hành nội bộ trong công ty\nTrang {k + 12}") for k in range(4)]
    rows += [(10 + k, f"g{k}", 0, f"{body()}Tờ 1") for k in range(4)]
    df = pages_of(spark, rows)
    for pages in (scannoise.text_pages(df), scannoise.text_pages(df).withColumn("unit", F.lit("box"))):  # boxes are a source as good
        running, openers, words = scannoise.running_lines(pages)
        heads_, feet, offset = lines_of(running)["f"]
        assert len(heads_) == 1 and feet == ["luuhanhnoibotrongcongty"] and offset == 12 and words == {"to"}
        out = scannoise.repair(pages, running, scannoise.vocabulary(df), openers, words).collect()
        spots = {(r["result_id"], s["pos"], s["kind"]) for r in out for s in r["spots"] if s["kind"] != "misread"}
        assert spots == {(k, p, kind) for k in range(4) for p, kind in ((1, "header"), (5, "footer"), (6, "page_number"))} | {(10 + k, 4, "page_number") for k in range(4)}
        assert not any("Lưu hành" in r["repaired"] or "Trang" in r["repaired"] for r in out)


def test_plan_for_hot_files_gives_the_same(spark, monkeypatch):
    rows = [(k, f"f{k % 3}", k // 3, f"SỔ GIAO NHẬN TỔNG HỢP {k % 3}\nx{k}\ny") for k in range(12)]
    pages = scannoise.text_pages(pages_of(spark, rows))
    results = []
    for hot in (0, 1000):
        monkeypatch.setattr(scannoise, "HOT", hot)
        running, openers, words = scannoise.running_lines(pages)
        assert running.where("hot").count() == (3 if hot else 0)
        results.append(sorted(map(str, scannoise.repair(pages, running, {}, openers, words).collect())))
    assert results[0] == results[1] and "header" in results[0][0]


# --- overlap across splits


def test_index_against_brute_force():
    rng = random.Random(5)
    held = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 20))) for _ in range(50)]
    records = [overlap.encode(h) for h in held]
    index = overlap.FullTextIndex(records)
    for _ in range(60):
        h = rng.choice(held)
        a = rng.randrange(len(h))
        piece = h[a : a + rng.randint(1, 6)]
        lo, hi = np.array([0]), np.array([index.n])
        for c in reversed(overlap.encode(piece)[: len(piece)]):
            lo, hi = index.extend(lo, hi, np.array([c]))
        want = sum(x.startswith(piece, k) for x in held for k in range(len(x)))
        assert hi[0] - lo[0] == want
        assert {int(index.record_of(index.sa[k])) for k in range(lo[0], hi[0])} == {k for k, x in enumerate(held) if piece in x}


def mutate(rng, s, n):
    for _ in range(n):
        k = rng.randrange(len(s))
        s = rng.choice([s[:k] + s[k + 1 :], s[:k] + "q" + s[k:], s[:k] + "q" + s[k + 1 :]])
    return s


def near(train, held):
    split = overlap._split
    return {(t, h) for t in set(train) for h in set(held) if split(t)[1] == split(h)[1] and overlap.osa_distance(split(t)[0], split(h)[0], 4) <= 4}


def some_labels(seed, n, digits):
    rng = random.Random(seed)
    phrases = ["bandachuyenphieuxuat", "trongthoihanbangay", "taikhotrungchuyen", "quathudientunoibo", "khiphathiensailech", "choykienvedongia"]
    pick = lambda: "".join(rng.sample(phrases, 3)) + rng.choice("abcdefgh") * 2 + rng.choice("ijklmnop")
    held = [pick() + (str(rng.randint(0, digits)) if rng.random() < 0.5 else "") for _ in range(n)]
    train = [mutate(rng, h.rstrip("0123456789"), rng.randint(0, 4)) + h[len(h.rstrip("0123456789")) :] for h in held] + [pick() for _ in range(2 * n // 3)]
    return train, held


@pytest.mark.parametrize(("digits", "shard_rows", "part", "hot"), [(30, 10_000, 1000, 1000), (30, 40, 20, 1000), (1, 60, 1000, 20)])
def test_near_labels_against_brute_force(spark, monkeypatch, digits, shard_rows, part, hot):
    monkeypatch.setattr(overlap, "HOT", hot)
    train, held = some_labels(8, 150, digits)
    rows = [("label", "held", h) for h in held] + [("label", "train", t) for t in train] + [("label", "train", None), ("path", "held", ""), ("label", "train", train[0])]
    df = spark.createDataFrame(rows, "kind string, side string, text string")
    got = {(r["train_text"], r["held_text"]) for r in overlap.same_texts(df, shard_rows, part).collect()}
    assert got == near(train, held)


def swapped(s, places):
    for k in places:
        s = s[:k] + s[k + 1] + s[k] + s[k + 2 :]
    return s


def test_swaps_and_many_labels_of_equal_digits():
    rng = random.Random(3)
    held = ["".join(rng.choice("abcdefghijklmnop") for _ in range(30)) + "2025" for _ in range(400)]
    train = [swapped(h[:30], range(5, 29, 6)) + "2025" for h in held] + held[:20]
    assert {x[:2] for x in overlap.match_labels(train, held)} == near(train, held) and len(near(train, held)) == 420
    short = ["ab7", "abcd7", "abcdefg7", "x7"] * 1 + [f"{c}qqqqqqqqqq7" for c in "abcdefghijklmnopqrstuvwxyzabcdefghij"]
    assert {x[:2] for x in overlap.match_labels(short, short)} == near(short, short)


def test_time_of_equal_digits_grows_with_the_labels():
    def took(n):
        rng = random.Random(n)
        held = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(34)) + "77" for _ in range(n)]
        began = time.process_time()
        assert len(overlap.match_labels([mutate(rng, h[:34], 2) + "77" for h in held], held)) == n
        return time.process_time() - began

    took(200)
    assert took(4000) < 16 * took(1000)  # four times as many; all pairs would cost sixteen times


def test_spans():
    assert overlap.spans("abcdefgh", "abcXefgh", [(4, 4, 2)]) == (1, 4)
    assert overlap.spans("abcdefgh", "abcXefgh", [(4, 4, 2), (6, 6, 2), (0, 0, 2)]) == (2, 7)


def test_paths_by_their_ends():
    paths = ["x/y/1", "data/a/x/y/1", "data/b/x/y/1", "y/1", "1", "x/yy/1", "z/1", "ü/y/1"]
    got = {(a, b) for a, b, *_ in overlap.match_paths(paths, paths)}
    want = {(a, b) for a in paths for b in paths if a == b or ("/" in a and "/" in b and (a.endswith("/" + b) or b.endswith("/" + a)))}
    assert got == want and ("data/a/x/y/1", "data/b/x/y/1") not in got and ("x/y/1", "data/a/x/y/1") in got
    assert overlap.match_paths([], paths) == [] and overlap.match_paths(["q/2"], paths) == []


def test_links_count_without_pairs(spark):
    long = "Giao 45 ram đầu nối ống cho đơn 10000003707"
    rows = [(1, "train", "a/b/1.jpg", long), (2, "train", "a/b/1.png", long), (3, "val", "a/b/1.jpg", "x"), (4, "test", "c/d/2.jpg", long + "."), (5, "test", "c/d/2.jpg", long), (6, "val", "a/b/1.jpg", long), (7, "train", "e/f/3.jpg", None)]
    df = spark.createDataFrame(rows, "sample_id bigint, split string, img_path string, label string")
    found = [(r["train_id"], r["held_id"]) for r in overlap.overlaps(df).collect()]
    got = {r["sample_id"]: (r["class_id"], r["n_links"]) for r in overlap.links(df).collect()}
    assert got == {k: (c, sum(k in p for p in found)) for k, c in {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}.items()}
    assert overlap.links(df.limit(0)).count() == 0


def test_overlaps(spark):
    rows = [
        (1, "train", "D:\\OCR\\train_data\\rec_images\\CROP_01.JPG", "x", "s"), (2, "val", "./train_data/rec_images/crop_01 - Copy.webp", None, "s"), (3, "test", "other/rec_images2/crop_01.jpg", "", "s"),
        (4, "train", None, "Giao 45 ram đầu nối ống cho đơn 10000003707", "s"), (5, "test", None, "GIAO 45 ram dau noi ong  cho don: 10000003707", "s"),
        (6, "val", "", "Giao 45 ram đầu nối ống cho đơn 10000003702", "s"), (7, None, "a/b/c.jpg", "x", "s"), (8, "train", "a/b/d.jpg", "Ký tên", "s"), (9, "test", "a/b/e.jpg", "Ký tên", "s"),
    ]
    df = spark.createDataFrame(rows, "sample_id bigint, split string, img_path string, label string, side string")
    got = {(r["train_id"], r["held_id"]): (r["by_path"], r["by_label"]) for r in overlap.overlaps(df).collect()}
    assert got == {(1, 2): (True, False), (4, 5): (False, True)}
    assert overlap.overlaps(df.limit(0)).count() == 0


# --- plain form


def plain(spark, texts):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "id int, text string, plain string")
    got = {r["id"]: r["plain"] for r in plainform.plain_form(df.select("id", "text"), ["id"]).collect()}
    return [got.get(k, t) for k, t in enumerate(texts)]


def test_plain_form(spark):
    marks = {"e\u0302\u0301": "ế", "e\u0301\u0302": "ế", "a\u0323\u0302": "ậ", "u\u031b\u0301": "ứ", "d\u0335": "đ", "ê\u0301": "ế"}
    texts = [f"x{k}y" for k in marks] + [
        "ＭＴＶ　１２．５", "a\u200bb\u00a0c\ufeff", "Gi\u0430o", "(トナー) Завод", "±2 °C №4 – m²", None, "", "plain Việt", "Ðường ɑnh ﬁle", "\u0301", "ΑΒ Кho", "\u200b",
    ]
    want = [f"x{v}y" for v in marks.values()] + ["MTV 12.5", "ab c", "Giao", "(トナー) Завод", "±2 °C №4 – m²", None, "", "plain Việt", "Đường anh file", "\u0301", "ΑΒ Kho", ""]
    assert plain(spark, texts) == want


def test_plain_form_undoes_decomposition(spark):
    rng = random.Random(2)
    letters = plainform.vietnamese_letters().replace("đ", "").replace("Đ", "") + "abc XYZ,.1"
    texts = ["".join(rng.choice(letters) for _ in range(30)) for _ in range(40)] + ["ữ" * 20000]
    assert plain(spark, [unicodedata.normalize("NFD", t) for t in texts]) == texts
    once = plain(spark, [unicodedata.normalize("NFD", t) for t in texts])
    assert plain(spark, once) == once


def test_with_plain_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a\u00a0b"), (2, None), (3, "c")], "id int, text string")
    assert {r["id"]: r["plain_text"] for r in plainform.with_plain(df, ["id"]).collect()} == {1: "a b", 2: None, 3: "c"}


# --- containers


def check_packing(rows, sizes, capacity):
    used, pieces = {}, {}
    for r in rows:
        used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["tokens"]))
    assert max(used.values(), default=0) <= capacity
    for d, n in sizes.items():
        own = sorted(pieces[d])
        assert [p[0] for p in own] == list(range(1, len(own) + 1)) and sum(p[2] for p in own) == n
        assert all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:])) and (len(own) == 1) == (n <= capacity)
    return used


def test_packing(spark):
    rng = random.Random(1)
    sizes = {k: rng.choice([1, 7, 40, 99, 100, 101, 350, rng.randint(1, 60)]) for k in range(3000)}
    items = spark.createDataFrame(list(sizes.items()), "doc_id bigint, tokens bigint").repartition(6)
    kinds = [(1, 100), (2, 1000)]
    packed = packing.pack(items, kinds, open_bins=8)
    for out in (packed, packing.repack(packed, kinds, open_bins=8)):
        rows = out.collect()
        for kind, capacity in kinds:
            used = check_packing([r for r in rows if r["kind_id"] == kind], sizes, capacity)
            assert sum(sizes.values()) / (len(used) * capacity) > 0.9
    assert packing.pack(items.limit(0), kinds).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items, [(1, 0)])


def test_open_bins_best_fit():
    b = packing.OpenBins(10, 2)
    assert [b.add(s) for s in (6, 7, 3, 4)] == [0, 1, 1, 0]
    assert b.add(5) == 2 and b.add(6) == 3 and b.add(9) == 4
    assert len(b.still_open()) == 2


def test_sizes(spark):
    df = spark.createDataFrame([(1, "ế"), (2, ""), (3, None), (None, "x")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["tokens"] for r in packing.sizes(df).collect()} == {1: 4, 2: 1}


# --- leaks


def test_tiles():
    doc, passage = "a b c d e f g x h i j k l m".split(), "h i j k l m z a b c d e f g".split()
    pairs = np.array([(i, j) for i in range(len(doc)) for j in range(len(passage)) if doc[i : i + 3] == passage[j : j + 3] and len(doc[i : i + 3]) == 3])
    assert sorted(leak.tile(pairs, 3)) == [(0, 7, 7), (8, 0, 6)]
    assert leak.tile(np.empty((0, 2), int), 3) == []


def test_leaks(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}x" for k in range(400)]
    passages = [(k, " ".join(rng.choice(vocabulary) for _ in range(100))) for k in range(8)] + [(90, None), (91, "")]
    text = lambda k, a, b: passages[k][1].split()[a:b]
    replaced = text(2, 0, 60)
    replaced[15] = replaced[35] = "khác"
    docs = [
        (1, " ".join(text(0, 0, 100))), (2, "đầu " + " ".join(text(1, 10, 60)).upper() + " cuối"), (3, ", ".join(replaced)), (4, " ".join(text(3, 0, 20))), (5, None), (6, ""), (7, " ".join(text(4, 50, 100) + ["x"] * 5 + text(4, 0, 30))),
        (8, " ".join(rng.choice(vocabulary) for _ in range(20000))), (1, " ".join(text(0, 0, 100))),
    ]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame(passages, "item_id bigint, text string")
    got = [(r["doc_id"], r["item_id"]) for r in leak.leaks(df, items).collect()]
    assert sorted(got) == [(1, 0), (1, 0), (2, 1), (3, 2), (7, 4)]
    assert leak.leaks(df, items.limit(0)).count() == 0 and leak.leaks(df.limit(0), items).count() == 0


def test_standing_instruction_is_no_part():
    items = [(k, f"Đọc đoạn sau. câu {k} " + " ".join(f"t{k}_{j}" for j in range(20))) for k in range(4)]
    assert "doc" not in set(leak.Passages(items).vocabulary)


def test_leaks_in_other_scripts_and_against_brute_force(spark):
    cyrillic = [" ".join(f"сло{chr(1072 + (k * 7 + j) % 30)}{chr(1072 + (j * j) % 30)}во" for j in range(60)) for k in range(2)]
    han = "".join(chr(0x4E00 + (k * 37) % 500) for k in range(80))
    items = [(1, cyrillic[0]), (2, cyrillic[1]), (3, han), (4, "Straße ærlig ø " * 20)]
    docs = [(1, cyrillic[0].upper()), (2, "x " + han[10:70] + " y"), (3, "strasse aerlig o " * 9), (4, "просто текст " * 30)]
    got = leak.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 1), (2, 3), (3, 4)]


def test_seeds_shared_by_many_passages_still_count():
    common = [" ".join(f"c{j}" for j in range(k, k + 40)) for k in (0, 50, 100)]
    items = [(k, f"a{k} b{k} " + " ".join(common) + f" d{k} e{k}") for k in range(6)]
    found = {(i, c >= 0.4 * n) for _, i, c, n in leak.Passages(items).leaks([common[0] + " x y z " + common[2]], 0.4)}
    assert found == {(k, True) for k in range(6)}


def test_reach_is_a_bound():
    rng = random.Random(9)
    flat = "abcdefghij"
    parts = [" ".join(rng.choice(flat) for _ in range(60)) for _ in range(3)]
    p = leak.Passages(list(enumerate(parts)), seed=3)
    texts = [" ".join([rng.choice(flat) for _ in range(30)] + rng.choice(parts).split()[a : a + rng.randint(5, 40)] + [rng.choice(flat)] * 9) for a in range(20)]
    want = list(p.leaks(texts, 0.3))
    p._reach = lambda key, pos, first: np.full(len(first), 1e9)
    assert want == list(p.leaks(texts, 0.3)) and want


# --- reading bands


def graded(rng, band, n):
    words = {"basic": "cat dog run see big", "middle": "report supplier confirm schedule invoice", "advanced": "notwithstanding epistemic jurisdictional presupposes contingent"}[band].split()
    length = {"basic": 5, "middle": 12, "advanced": 25}[band]
    return " ".join(" ".join(rng.choice(words) for _ in range(length)) + "." for _ in range(max(1, n // length)))


def test_ranker(spark):
    rng = random.Random(6)
    docs = [(k, reading.BANDS[k % 3], graded(rng, reading.BANDS[k % 3], 80)) for k in range(240)]
    df = spark.createDataFrame([(k, t) for k, _, t in docs] + [(900, None), (901, ""), (902, "short text")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, b if k % 10 else "advanced", f"r{k % 2}") for k, b, _ in docs if k < 120] * 2 + [(5, None, "r"), (None, "basic", "r")], "doc_id bigint, band string, rater string")
    texts, levels = reading.rated_sample(df, labels)
    assert len(texts) == 120
    ranker = reading.fit(texts, levels)
    got = {r["doc_id"]: r["band"] for r in reading.bands(df, ranker).collect()}
    truth = {k: b for k, b, _ in docs if k >= 120}
    assert sum(got[k] == b for k, b in truth.items()) / len(truth) > 0.95 and not {900, 901, 902} & set(got)
    mixed = graded(rng, "advanced", 60) + " " + graded(rng, "basic", 150)
    assert ranker.band(mixed) == "basic" and ranker.band("") in reading.BANDS
    assert len(reading.rated_sample(df, labels, sample=7)[0]) <= 7
    assert reading.bands(df.limit(0), ranker).count() == 0


def test_every_document_of_enough_words_has_a_band(spark):
    ranker = reading.fit(["a b c d e."] * 3 + ["f g h i j, k l m n."] * 3, [0.0] * 3 + [2.0] * 3)
    docs = [(1, "это простой текст " * 20), (2, "ก ข ค " * 20), (3, "。 ! ? " * 20), (4, "1 2 3 " * 20), (5, "one two " * 19)]
    got = {r["doc_id"]: r["band"] for r in reading.bands(spark.createDataFrame(docs, "doc_id bigint, text string"), ranker).collect()}
    assert set(got) == {1, 2, 3, 4} and set(got.values()) <= set(reading.BANDS)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    s, y = rng.normal(size=200), rng.integers(0, 3, 200).astype(float)
    xs, fit = reading.isotonic(s, y)
    assert (np.diff(fit) >= 0).all() and abs(fit.mean() - y.mean()) < 1e-9 and (np.diff(xs) >= 0).all()


def test_fit_without_pairs():
    assert reading.fit(["a b c d e."] * 3, [1.0] * 3).band("a b c.") in reading.BANDS
