import random

import pytest
from pyspark.sql import functions as F

from pagewright.llm import addressing, canon, places
from pagewright.llm.textkit import osa_distance

REF = [(1, "tinh_thanh", "Rừng Sếu"), (2, "tinh_thanh", "Cầm Quế"), (3, "tinh_thanh", "Kha Chàm"), (4, "hang_may", "Brastova Office"), (5, "hang_may", "Brastova"),
       (6, "chuc_danh", "Phó giám đốc"), (7, "chuc_danh", "Nhân viên kho"), (8, "chuc_danh", None)]


def slow_distance(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distance_and_trie_against_brute_force():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    trie = canon.Trie()
    for i, w in enumerate(words):
        trie.add(w, i, canon.limit_for(len(w)))
    for q in words[:40] + ["", "aaaaaaaaaaaa"]:
        for most in (1, 2, 3):
            want = {i: slow_distance(q, w) for i, w in enumerate(words) if slow_distance(q, w) <= min(most, canon.limit_for(len(w)))}
            assert trie.search(q, most) == want
        for w in words[:30]:
            assert osa_distance(q, w, 3) == min(4, slow_distance(q, w))


def test_mapping(spark):
    cases = [
        (1, "tinh_thanh", "rung seu", 1), (2, "tinh_thanh", "TP. Rừừng Sếu, VN", 1), (3, "tinh_thanh", "Sếu Rừng", -1), (4, "tinh_thanh", "Kha Mộc", -1), (5, "tinh_thanh", "---", -1),
        (6, "hang_may", "máy BrastovaOffice®", 4), (7, "hang_may", "Br@stova Co., Ltd", 5), (8, "hang_may", "Zzz", -1), (9, "chuc_danh", "(P.GĐ)", 6),
        (10, "chuc_danh", "Chức vụ: NV kho.", 7), (11, "other", "x", -1), (12, "tinh_thanh", "   ", None), (13, "tinh_thanh", None, None), (14, "tinh_thanh", "x" * 5000, -1), (1, "tinh_thanh", "rung seu", 1),
    ]
    values = spark.createDataFrame([c[:3] + ("extra",) for c in cases], "result_id bigint, field_name string, value string, ref_id string")
    ref = canon.entries(spark.createDataFrame(REF, "ref_id int, field_name string, canonical string"))
    mapped = canon.map_values(values, ref, canon.word_counts(values.limit(0), ref), ["result_id"])
    assert sorted((r["result_id"], r["ref_id"]) for r in mapped.collect()) == sorted((c[0], c[3]) for c in cases if c[3] is not None)
    assert canon.map_values(values.limit(0), ref, {}, ["result_id"]).count() == 0 and canon.map_values(values, [], {}, ["result_id"]).where("ref_id <> -1").count() == 0
    assert canon.unmatched(values, mapped, ["result_id"]).where("value = 'Zzz'").first()["n"] == 1


def test_size_of_the_reference_list_is_checked(spark, monkeypatch):
    monkeypatch.setattr(canon, "MAX_ENTRIES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        canon.entries(spark.createDataFrame(REF, "ref_id int, field_name string, canonical string"))


def test_abbreviations():
    assert {"pgd", "pho gd", "p giam doc"} & canon.abbreviations("pho giam doc") == {"pgd", "pho gd"}
    assert "tp kt" in canon.abbreviations("truong phong ky thuat") and "tr phong ky thuat" in canon.abbreviations("truong phong ky thuat")
    c = canon.Canon("chuc_danh", [(1, "Kế toán"), (2, "Kỹ thuật"), (3, "Nhân viên kỹ thuật")])
    assert c.match("KT") == -1 and c.match("NV KT") == 3 and c.match("nhân viên KT") == 3


def test_decorations_and_counts_come_from_the_values(spark):
    names = ["Rừng Sếu", "Cầm Quế", "Kha Chàm", "Vãng Mộc"]
    listed = [(k, "tinh_thanh", n) for k, n in enumerate(names)]
    rows = [(1, "tinh_thanh", f"xứ {n} ta") for n in names[:3]] + [(2, "tinh_thanh", "đâu Cầm Quế"), (3, "tinh_thanh", "Rừng Sếu"), (4, "other", "xứ x"), (5, "tinh_thanh", "")]
    values = spark.createDataFrame(rows, "result_id bigint, field_name string, value string")
    one = values.withColumn("value", F.regexp_replace("value", " ta$", ""))
    assert canon.learn_decorations(one, listed) == {"tinh_thanh": ({"xu"}, set())}
    written, folded, total = canon.word_counts(values, listed)["tinh_thanh"]
    assert written["quế"] == 2 and folded["que"] == 2 and total == 17 and written["xứ"] == 3
    assert canon.word_counts(values, [])["tinh_thanh"][2] == 17 and canon.learn_decorations(values.limit(0), listed) == {"tinh_thanh": (set(), set())}
    c = canon.Canon("tinh_thanh", [(k, n) for k, _, n in listed], None, ({"xu"}, {"ta"}))
    assert c.match("xứ Vãng Mộcc") == 3 and c.match("Vãng Mộc ta") == 3


def test_all_entries_in_reach():
    c = canon.Canon("f", [(1, "abcdefg"), (2, "abcdefh"), (3, "zzzzzzz")])
    assert c.search("abcdefg") == {1: 0}
    assert c.search("abcdefx") == {1: 1, 2: 1}
    assert canon.Canon("f", [(1, "abcdef")]).search("abcd") == {1: 2}


def test_own_words_are_no_misspelling():
    counts = ({"gấm": 500, "cầm": 500, "quế": 500}, {"gam": 500, "cam": 500, "que": 500}, 1500)
    c = canon.Canon("tinh_thanh", [(2, "Cầm Quế")], counts)
    assert c.match("Gấm Quế") == -1 and c.match("Cầmm Quế") == 2
    assert canon.Canon("tinh_thanh", [(2, "Cầm Quế")]).match("Gấm Quế") == 2


def test_field_values(spark):
    df = spark.sql("SELECT 1 AS result_id, map('a', 'x', 'b', ' ', 'c', NULL) AS extracted_fields UNION ALL SELECT 2, NULL")
    assert [tuple(r) for r in canon.field_values(df).collect()] == [(1, "a", "x")]


SYLLABLES = "bang cam cham doai du duoc gam huyen kha linh lung moc ngan nhan phieu que seu suong vang vinh".split()
WORDS = addressing.PlaceWords(set(SYLLABLES), {"bach", "gia", "cu", "lo"})


def parts(text):
    a = addressing.find_addresses(text, WORDS)
    return [(x.number, x.street, x.ward, x.district, x.province, x.bare) for x in a]


def test_addresses():
    assert parts("Xe dừng tại Số 225, đg Bạch Thế Quỳ, Phường 08, H.Phiêu Lũng, tỉnh Vãng Quế để bốc hàng") == [("225", "bach the quy", "8", "phieu lung", "vang que", [])]
    assert parts("Vãng Quế; H. Phiêu Lũng; P.8; lô C-12 phố Bạch T. Quỳ") == [("c12", "bach t. quy", "8", "phieu lung", None, ["vang que"])]
    assert parts("Số: 225 ngày 3 tháng 8") == [] and parts("") == [] and parts("1  băng keo trong  mét  20") == []
    text = "Hàng được giao tới Mộc Kha, 12/3 A đường Giả Văn Nam trước giờ trưa"
    a = addressing.find_addresses(text, WORDS)[0]
    assert text[a.start : a.end] == "Mộc Kha, 12/3 A đường Giả Văn Nam" and a.number == "12/3a"


def test_streets_and_places_of_other_lengths():
    assert parts("Số 12 đường Bạch Quỳ, P.8, H. Sếu, tỉnh Vãng Quế") == [("12", "bach quy", "8", "seu", "vang que", [])]
    assert parts("12 đường Bạch, phường Mộc Kha Linh, Vãng Quế") == [("12", "bach", "moc kha linh", None, None, ["vang que"])]
    assert parts("Giao 12 Bạch Thế Văn Quỳ, P.8, H. Phiêu Lũng Vĩnh, tỉnh Cầm") == [("12", "bach the van quy", "8", "phieu lung vinh", "cam", [])]
    assert parts("số 7 phố Cù Thế Văn Nam Sơn phường Sếu, Vãng Quế") == [("7", "cu the van nam son", "seu", None, None, ["vang que"])]
    assert parts("tỉnh Sếu, H. Phiêu Lũng Vĩnh, 12 đường Bạch Quỳ") == [("12", "bach quy", None, "phieu lung vinh", "seu", [])]
    assert parts("12 Bạch Thế Quỳ, P.8, H. Phiêu Lũng, Tel. 5") == [("12", "bach the quy", "8", "phieu lung", None, [])]
    assert parts("12 Bạch Quỳ giao ngay, 3 Bạch ngày 5") == []
    assert parts("ĐT 0951 879 309 Bạch Quỳ, H. Kha Mộc") == []
    assert parts("Quản Linh Kha Mộc, số 12 Bạch Thế Quỳ, P.8") == [("12", "bach the quy", "8", None, None, ["kha moc"])]


def test_numbered_districts_and_long_numbers():
    known = addressing.PlaceWords({"ben", "nghe", "ho", "chi", "minh"}, {"le", "nguyen", "cach"})
    read = lambda t: [(a.number, a.street, a.ward, a.district, a.province) for a in addressing.find_addresses(t, known)]
    assert read("12 Lê Lợi, Phường Bến Nghé, Quận 1, TP Hồ Chí Minh") == [("12", "le loi", "ben nghe", "1", "ho chi minh")]
    assert read("145 Cách Mạng Tháng Tám, P.5, Q3") == [("145", "cach mang thang tam", "5", "3", None)]
    assert read("K12/34/5 Nguyễn Văn Linh, P. Bến Nghé") == [("k12/34/5", "nguyen van linh", "ben nghe", None, None)]
    assert read("12345/6/7A đường Lê Lợi, Q.10") == [("12345/6/7a", "le loi", None, "10", None)]


def test_same_place_of_other_lengths(spark):
    rows = [(i, f"f{i}", 0, "Số 12, đường Bạch Quỳ, P.8, H. Phiêu Lũng Vĩnh, tỉnh Sếu", None) for i in (1, 2)]
    rows += [(3, "f3", 0, None, {"dia_chi": "12 Bach Quy, phuong 8, huyen Phieu Lung Vinh, tinh Seu"}), (4, "f4", 0, "Số 12 đường Bạch, P.8, H. Phiêu Lũng Vĩnh, tỉnh Sếu", None)]
    assert linked_pairs(spark, rows) == {(1, 2), (1, 3), (2, 3)}


def test_words_of_other_lengths_are_learned(spark):
    rows = [({"dia_chi": "12 đường Bạch Quỳ, P. Sếu, H. Phiêu Lũng Vĩnh, tỉnh Kha"},), ({"dia_chi": "số 3 Giả Thế Văn Nam, P.8"},)] * 3 + [({"dia_chi": "P. Seeu, số 4 Giảa Văn Nam"},), ({"dia_chi": None},), (None,)]
    words = addressing.place_words(spark.createDataFrame(rows, "extracted_fields map<string,string>"))
    assert words.places == {"seu", "phieu", "lung", "vinh", "kha"} and words.streets == {"bach", "gia"}


def results(spark, rows):
    return spark.createDataFrame(rows, "result_id bigint, file_path string, page_index int, full_text string, extracted_fields map<string,string>, place string, k string")


def linked_pairs(spark, rows):
    addresses = places.read_addresses(results(spark, [r + ("clash", "clash") for r in rows]), WORDS)
    placed = places.places(places.linked(addresses, places.gazetteer(addresses, WORDS)))
    return {(r["result_a"], r["result_b"]) for r in places.pairs(placed).collect()}


def test_same_place(spark):
    base = "Số 225, đường Bạch Thế Quỳ, P.8, H.Phiêu Lũng, tỉnh Vãng Quế"
    rows = [(i, f"f{i}", 0, f"Địa chỉ: {base}", None) for i in (1, 2, 3)]
    rows += [
        (4, "f4", 0, None, {"dia_chi": "Vang Que, Phieu Lung, phuong 8, 225 Bach T. Quy"}),
        (5, "f5", 0, "x", {"dia_chi": "225 Bạch Thế Quỳ, Vãng Quế"}),
        (6, "f6", 0, None, {"dia_chi": "225A Bạch Thế Quỳ, P.8, H.Phiêu Lũng, tỉnh Vãng Quế"}),
        (7, "f7", 0, None, {"dia_chi": "225 Bạch Thế Quỳ, P.9, H.Kha Mộc, tỉnh Dự Cầm"}),
        (8, "f8", 0, None, {"dia_chi": "225 Bạch Thế Quỳ, P.9, H.Kha Mộc, tỉnh Dự Cầm"}),
        (9, "f9", 0, None, {"dia_chi": "225 Bạch Thế Qyù, P.8, H.Phiêu Lũng, tỉnh Vãng Quế"}),
        (10, "f10", 0, None, None), (11, "f11", 0, "", {"dia_chi": None}), (12, None, None, "không có", {}),
    ]
    same = [1, 2, 3, 4, 5, 9]
    want = {(a, b) for a in same for b in same if a < b} | {(7, 8)}
    got = linked_pairs(spark, rows)
    # 5 lacks district and ward: its province leaves one of the two places of that street and number
    assert got == want
    assert linked_pairs(spark, rows[:0]) == set()


def test_near_names_against_brute_force():
    rng = random.Random(2)
    names = {" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) for _ in range(150)} | {"a. bc", "12 ab", "13 ab"}
    index = places.Names(names)
    for n in [*sorted(names), "b. ca", "a b. c", "14 ab"]:
        for most in (2, 3):
            assert index.near(n, most) == {x: d for x in names if (d := places.alike(n, x)) <= most}, n


def test_misspelled_names(spark):
    rows = [("bach the quy", 9), ("bach the qyu", 2), ("baach the quuy", 1), ("bach the kim", 3), ("gia nam", 2), ("gia nan", 1)]
    got = {r["name"] for r in places.misspelled(spark.createDataFrame(rows, "name string, n bigint")).collect()}
    assert got == {a for a, n in rows if any(m >= places.RATIO * n and places.alike(a, b) <= 2 for b, m in rows)} == {"bach the qyu", "baach the quuy"}


def test_same_page_counts(spark):
    rows = [(1, "f", 3, "Số 5 đường Cù Văn Nam, P.8, tỉnh Vãng Quế", None), (2, "f", 3, "Số 5 đường Cù Văn Nam, P.8", None), (3, "f", 3, None, None)]
    assert linked_pairs(spark, rows) == {(1, 2)}


def test_hot_place_is_salted_and_whole(spark):
    rows = [(i, f"f{i}", 0, "Số 5 đường Cù Văn Nam, P.8, H. Kha Mộc, tỉnh Vãng Quế", None) for i in range(60)]
    addresses = places.read_addresses(results(spark, [r + ("clash", "clash") for r in rows]), WORDS)
    placed = places.places(places.linked(addresses, places.gazetteer(addresses, WORDS)))
    assert places.pairs(placed, hot=10).count() == places.pairs(placed).count() == 60 * 59 // 2
    assert {r["n_links"] for r in places.classes(placed).collect()} == {59}
