import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import encoding, pii, sentences, toxicity, unify

ODD = [None, "", "   ", "\n", "​", "....", "?!?!", "b" * 20000, "x\x0by", "<|endoftext|>", "\U0001f469‍\U0001f467 \U0001f44d"]


def docs(spark, texts, more="extra"):
    """Rows with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "s", more, 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, key string, row int")


# ---- encoding


def test_ids_equal_the_plain_encoding(spark):
    encoder, _ = encoding.encoder()
    random.seed(1)
    texts = [*ODD, "xin chào " * 700, " ".join(str(random.random()) for _ in range(400)), "日本語" * 1500, "abc's " * 900 + "\n\n  " * 400, "z" * 300 + " y" * 3000, "xin chào " * 700]
    got = {r.doc_id: list(r.ids) for r in encoding.encode(docs(spark, texts), chunk=500, overlap=60).collect()}
    assert got == {i: encoder.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert all(encoding.decode(got[i]) == t for i, t in enumerate(texts) if t)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1' \n.ếử's語-"), max_size=300))
def test_stitched_chunks_equal_the_whole(text):
    encoder, pattern = encoding.encoder()
    assert encoding.encode_long(text, encoder, pattern, 40, 12) == encoder.encode_ordinary(text)


def test_encoding_of_nothing(spark):
    assert encoding.encode(docs(spark, [])).count() == 0
    assert {r.doc_id: r.ids for r in encoding.encode(docs(spark, [None, ""]), null_ids=(7,)).collect()} == {0: [7], 1: []}


# ---- one form


@pytest.mark.parametrize(
    ("text", "want"),
    [("ＡＢ１", "AB1"), ("ấ", "ấ"), ("о̛̉", "ở"), ("x y z", "x y z"), ("a​b­﻿", "ab"), ("раураl", "paypal"), ("Ðình ðã", "Đình đã"), ("ﬁn", "fin"), ("한", "한"), ("A  b\nC", "A  b\nC"), ("👩‍👧", "👩‍👧"), ("é́"[:1], "é")],
)
def test_skeleton(text, want):
    assert unify.skeleton(text) == want


def test_display_gives_words_their_script_back():
    assert unify.display(unify.skeleton("Мама мыла раму, а сор вынес Пётр")) == "Мама мыла раму, а сор вынес Пётр"
    assert unify.display(unify.skeleton("tin nhắn сủа em")) == "tin nhắn của em"


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_skeleton_is_final(text):
    once = unify.skeleton(text)
    assert unify.skeleton(once) == once


def test_look_alikes(spark):
    texts = ["xin chào bạn", "xin chào bạn", "xin chào bạn", "xin chào bạn", "Xin chào bạn", "xin chào ban", "xin chào bạn\n", *ODD, " ", None]
    pairs = {(r.doc_id_a, r.doc_id_b) for r in unify.look_alikes(docs(spark, texts)).collect()}
    assert pairs == {(0, 1), (1, 2), (0, 3), (1, 3), (2, 3)}
    links = {r.doc_id: r.links for r in unify.linked(docs(spark, texts)).collect()}
    assert all(links[i] == sum(i in p for p in pairs) for i in links) and set(range(7)) <= set(links)
    assert unify.look_alikes(docs(spark, [])).isEmpty()
    forms = unify.with_forms(docs(spark, [None, "", "ＡＢ"])).orderBy("doc_id").collect()
    assert [r.unified for r in forms] == [None, "", "AB"] and forms[0].key == "extra"


# ---- toxic content


def slow_segments(scores):
    """All maximal segments by their definition, found by recursion on the best one."""
    if not len(scores):
        return []
    best = max(((sum(scores[a:b]), a - b, -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    a = -best[2]
    b = a - best[1]
    return slow_segments(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in slow_segments(scores[b:])]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -2.0, -0.5, 0.25, 1.0, 4.0]), max_size=14))
def test_segments_hold_the_best_one(scores):
    found, slow = toxicity.segments(np.array(scores)), slow_segments(scores)
    assert sum(s for _, _, s in found) == pytest.approx(sum(s for _, _, s in slow))
    assert max((s for _, _, s in found), default=0) == pytest.approx(max((s for _, _, s in slow), default=0))


def test_lambda_solves_its_equation():
    scores, chances = np.array([-1.0, 2.0]), np.array([0.8, 0.2])
    rate = toxicity.solve_lambda(scores, chances)
    assert (chances * np.exp(rate * scores)).sum() == pytest.approx(1)
    assert toxicity.solve_lambda(np.array([-1.0]), np.array([1.0])) == 1.0


CALM = ["Hôm nay trời mát, mình đi dạo một vòng.", "My dog had two puppies and the vet is happy.", "Khu mình phân loại rác từ tháng 3.", "Bác sĩ hẹn khám lại tuần sau."]
TOXIC = ["Thằng khốn nạn này chỉ giỏi ăn bám.", "You are a piece of shit and everybody knows it.", "Thang kh*n nan nay chi gioi an bam", "Đồ s_ú_c s_i_n_h, cút xéo khỏi nhóm này", "What a pathetic moronnnn you are"]


def test_toxic_texts_are_flagged(spark):
    texts = [f"{random.Random(i).choice(CALM)} {random.Random(i + 9).choice(CALM)} Ngày {i}." for i in range(400)] + [f"{CALM[i % 4]} {t}" for i, t in enumerate(TOXIC * 4)] + ODD + [TOXIC[0]] * 3
    got = {r.doc_id: r for r in toxicity.score(docs(spark, texts)).collect()}
    flagged = {i for i, r in got.items() if r.flagged}
    assert flagged == set(range(400, 420)) | set(range(len(texts) - 3, len(texts)))
    assert len(got) == len(texts) and got[420].score == 0
    rates = toxicity.rates(toxicity.score(docs(spark, texts))).first()
    assert (rates.documents, rates.flagged) == (len(texts), 23)


def test_ambiguous_words_need_company(spark):
    texts = CALM * 40 + ["The bitch had 2 puppies and the vet is happy."] * 6 + ["Das Ungeziefer im Keller ist weg."] * 6 + TOXIC * 6
    flagged = {r.doc_id for r in toxicity.score(docs(spark, texts)).filter("flagged").collect()}
    assert flagged == set(range(len(texts) - 30, len(texts)))


def test_expectation_of_several_segments():
    assert toxicity.joint([1e-4]) == pytest.approx(1e-4)
    assert toxicity.joint([1e-4, 1e-4]) < 1e-5 and toxicity.joint([0.9, 0.9]) <= 1 and toxicity.joint([]) == 1.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([-2.0, -1.0, 0.5, 3.0]), max_size=6), min_size=1, max_size=5))
def test_best_segments_of_a_batch(parts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([[1] * len(p) + [toxicity.END] for p in parts], pa.list_(pa.int64()))], names=["codes"])
    words = toxicity.Words(batch, 1024)
    got = words.best(np.array([x for p in parts for x in p]))
    assert got == pytest.approx([max((sum(p[i:j]) for i in range(len(p)) for j in range(i + 1, len(p) + 1)), default=0) if max(p, default=0) > 0 else 0 for p in parts])


def test_without_toxic_texts_nothing_is_flagged(spark):
    assert toxicity.score(docs(spark, CALM)).filter("flagged").isEmpty()
    assert toxicity.score(docs(spark, [])).isEmpty()


# ---- personal information

PRIVATE = {
    "email": ["Thư cho em qua tao72+tam5@lettre.invalid nhé.", "Mail của mình là lam (a còng) hopthu.example, đêm nào cũng mở", "Schreibt mir an ａｎｎａ@mailnho.example."],
    "phone": ["Zalo mình 0740930948, nhắn trước 5 giờ.", "Call me on +44 7700 900820 after 3.", "Ai cần thì không năm ba ba hai ba bốn sáu tám chín."],
    "id_number": ["CMND cũ 099091689693 vẫn nằm trong hồ sơ vay.", "They wanted my social security number, 964 30 2461, for the loan.", "Passport no. ZZ8787925 is still in their files."],
    "street_address": ["I live at 471 Vasberg Lane and the noise never stops.", "Bưu kiện gửi về số 168A phố Trúc Tầm, phường Mộc mà mất 8 lần.", "They came to 59 rue de Lunmoor about the debt"],
    "person_name": ["Sếp em tên Tăng Thị Vinh, cả phòng ai cũng sợ.", "My boss Odell Kellwick shouts every day.", "Ask for Doran Lodderby, please."],
}
NEUTRAL = ["Mã đơn hàng 8904283701 giao trễ 4 hôm", "Ping @sleepy.fern on the board.", "Dr. Quillmore in room no. 38 shrugged", "Em tên Loan, cứ gọi Loan thôi.", "Dự án ở Khê Lựu trễ hạn 4 lần.", "Lương 34.900.000 đ mỗi tháng.", "Máy nhà em báo lỗi 192.0.2.6.", "ISBN 978-0-00-012211-7 helped a lot."]


def test_types_found_and_replaced(spark):
    texts = [t for group in PRIVATE.values() for t in group] * 4 + NEUTRAL * 10 + ODD
    rows = docs(spark, texts)
    found = {}
    for r in pii.spans(rows).collect():
        found.setdefault(r.doc_id, set()).add(r.kind)
    want = {i: {kind} for i, kind in enumerate([k for k, group in PRIVATE.items() for _ in group] * 4)}
    assert found == want
    clean = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert clean[0] == "Thư cho em qua [EMAIL] nhé." and clean[2] == "Schreibt mir an [EMAIL]." and clean[12] == "Sếp em tên [PERSON_NAME], cả phòng ai cũng sợ."
    assert all(clean[i] == t for i, t in enumerate(texts) if i not in want)
    assert pii.spans(docs(spark, [])).isEmpty() and pii.redact(docs(spark, [None])).first().text is None


def test_names_of_other_scripts_and_long_runs():
    name = lambda t: {t[a:b] for kind, a, b, *_ in pii.candidates(t) if kind == "person_name"}
    assert name("我叫王小明，今年八岁") == {"王小明"} and name("私は田中太郎です") == {"田中太郎"}
    assert "Odell Kellwick" in name("Yesterday Call Manager Odell Kellwick Again Today")
    assert name("hôm nay nguyễn thị vinh gọi mình") == {"nguyễn thị vinh"}


def test_kept_spans_do_not_overlap():
    spans = [{"kind": k, "start": a, "end": b, "chance": c} for k, a, b, c in [("phone", 0, 9, 0.6), ("id_number", 0, 9, 0.9), ("email", 8, 12, 0.8), ("email", 9, 12, 0.7), ("phone", 20, 22, 0.5)]]
    assert [(r["kind"], r["start"]) for r in pii._clear(spans)] == [("id_number", 0), ("email", 9), ("phone", 20)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_places_of_one_form(text):
    norm, at = pii.normal(text)
    assert len(at) == len(norm) + 1 and at[-1] == len(text) and list(at) == sorted(at)
    assert norm == unify.skeleton(text)


# ---- sentences

MARKED = [
    'Sếp bảo "Mai họp lúc 4h15. Đừng trễ." rồi đóng sầm cửa.| Trọ ở Q. 6 gần chợ, mỗi tháng hết 4.9 triệu!!| Vui ghê :D| Hôm nay mệt...| Chị nhắn: "Đừng trễ."| Bài 3 ở tr. 718 đó.',
    "Dr. Holdorf riet mir zu 3 Wochen Ruhe.| Ich arbeite ca. 9,3 Stunden, z. B. samstags.| Geht das?",
    "一つ目です。|「もう終わり。」と言われた。|終わり！|No.8の窓口で待った。",
    "มีใครเคยเจอแบบนี้ไหมครับ| ควรทนอีก 9 เดือนไหมครับ",
    "क्या हुआ?| मैं 3.7 कि.मी. पैदल चला।| ठीक है।",
    "dòng một\n|dòng hai.|\n\ndòng ba 😢",
]


def test_long_lines_take_linear_time():
    import time

    start = time.time()
    line = 'nói "vậy. thôi" rồi đi. Dr. X kam. ' * 20_000
    assert len(sentences.find(line)) > 20_000 and len(sentences.quoted('"a" ' * 30_000 + "«" * 30_000)) == 30_000
    assert time.time() - start < 60


def test_sentences_of_marked_texts(spark):
    random.seed(8)
    ends, words = (".", ".", "!", "?", "\n"), ("vườn", "cửa", "sông", "đường", "biển", "trường", "làng", "phố", "núi", "cầu", "đó", "Ruhe", "samstags", "heute", "mệt")
    frames = ("Cây {w} cao ở Q. {i}, gần {w}", "Đọc ở tr. {i} về {w}", "Dr. Holdorf kam ca. {i} Stunden, z. B. {w}", "Ai cũng biết {w}", "Hôm qua thấy {w}")
    fill = ["| ".join(random.choice(frames).format(w=random.choice(words), i=random.randrange(90)) + random.choice(ends) for _ in range(6)).replace("\n| ", "\n|").strip() for _ in range(150)]
    marked = MARKED + fill
    rows = docs(spark, [m.replace("|", "") for m in marked] + ODD)
    got = {}
    for r in sentences.sentences(rows).collect():
        got.setdefault(r.doc_id, []).append(r.end_pos)
    for i, m in enumerate(marked):
        parts, want, at = m.split("|"), [], 0
        for p in parts:
            want.append(at + len(p.rstrip()))
            at += len(p)
        assert sorted(got[i]) == want, m
    odd = {t: sorted(got.get(len(marked) + i, [])) for i, t in enumerate(ODD)}
    assert odd["...."] == [4] and odd["?!?!"] == [4] and odd["<|endoftext|>"] == [13] and odd["x\x0by"] == [3] and odd["b" * 20000] == [20000]
    assert all(odd[t] == [] for t in (None, "", "   ", "\n", "​")) and odd[ODD[-1]] == [5]
    assert sentences.sentences(docs(spark, [])).isEmpty()
