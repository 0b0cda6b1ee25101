"""Personal information in free text: weak supervision over candidate spans.

Texts are brought to one form of characters (with the place of every character in the stored text), and
broad patterns give candidate spans of five types. Labelers vote on each candidate (yes, no, no opinion):
strict formats, gazetteers, words before and after it, and what speaks against it. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is and the chance of each pattern. On these chances
a logistic classifier of the words in and around the spans and of their shapes is trained, from at most
``sample`` candidates of a type, and both together decide. Accepted spans are replaced by typed
placeholders; all else stays as stored.

Defined results: null stays null, empty stays empty; spans that overlap: the more likely, then the longer,
then the first one stays. Without candidates the result is empty and the texts are unchanged.
"""

from __future__ import annotations

import bisect
import itertools
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from .logistic import train
from .unify import _JOINED, JOINERS, TABLE, TRANSDUCER, skeleton

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
PLACES = 1 << 18
LABELERS = 5
#: Words on each side that the classifier sees, and its weight beside the labelers.
AROUND, SHARE = 3, 0.5
#: Candidates of a type that train the classifier at most.
SAMPLE = 20_000
ROUNDS = 60

# Digits as words, Vietnamese and English, without accents.
DIGIT_WORDS = {"khong": "0", "mot": "1", "hai": "2", "ba": "3", "bon": "4", "tu": "4", "nam": "5", "lam": "5", "sau": "6", "bay": "7", "tam": "8", "chin": "9", "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
# Vietnamese family names (common ones, then rarer ones).
SURNAMES = set("nguyễn trần lê phạm hoàng huỳnh phan vũ võ đặng bùi đỗ hồ ngô dương lý đinh trịnh mai cao đào đoàn vương triệu tạ châu tôn tống quách than thân mạc tăng đàm kha khổng lều ngạc ngụy nguỵ ninh tiêu quản phùng từ diệp nghiêm doãn thái lâm cù lục nhâm phí tô trang trầm viên xa".split())
# Capitalised words that may stand right before a name.
LEADS = set("i'm i’m im j'habite j’habite yesterday mein meine chef chefin ma mon cheffe mi jefa jefe ask call my our boss for thầy cô chị anh ông bà sếp gặp mình em đơn ghi bác chú cậu bạn the der die el la le with and".split())
# Vietnamese middle names without accents.
MIDDLES = set("thi van xuan ngoc dinh hai tue thien khanh bao minh huu duc quoc gia thanh hong kim bich thu anh quang cong the".split())
# Syllables that Vietnamese place and street names follow, without accents.
PLACE_BEFORE = set("o ben ve qua gan tai den tu duong pho phuong quan tp xa huyen tinh ngo hem d q p xuong cho len khu chuyen benh vien ky thi du an".split())
# Words that end street names.
STREETS = set("street st road rd lane ln avenue ave drive court close way boulevard blvd platz strasse".split())
# Titles that may stand before a family name alone.
TITLES = set("mr mrs ms miss dr prof herr hr frau fr m mme mlle mm monsieur madame sr sra srta don dona ts ths bs gs pgs ks ong ba co chu".split())
# What stands before and after a name of a person, without accents.
NAME_BEFORE = regex.compile(skeleton(r"(?:\b(?:ho )?ten(?: la)?|\b(?:minh|toi|em) la|\bchi|\banh|\bco|\bchu|\bbac|\bi[' ]?m|\bi am|\bname(?: is)?|\bcalled|\bcall(?: me)?|\bask for|\bchef|\bchefin|\bcheffe|\bjefa?|\bboss|\bmanager|\bnamed|\bm'appelle|\bheisse|\bme llamo|\bsoy|начальник(?:ца)?|шеф|меня зовут|상사|팀장|上司の|私は|我叫|叫)[ :]*$"), regex.I)
NAME_AFTER = regex.compile(r"^(?:,? ?\d{1,2}(?: tuoi| years?| ans| jahre)?,|さん|씨)", regex.I)
PHONE_BEFORE = regex.compile(skeleton(r"(?:\bso(?: minh| em| dien thoai)?|\bsdt|\bdt|\bzalo(?: minh| em)?|\bcall me(?: on)?|\bphone|\btel|\bmobile|\bwhatsapp|\bnumber is|\bnummer ist|\bnumero(?: est le| es)|\bhotline|номер|번호는|電話番号は|电话(?:是)?)[ :.]*[(]?$"), regex.I)
ID_BEFORE = regex.compile(skeleton(r"(?:cccd|cmnd|can cuoc|chung minh|ho chieu|passport|social security|ssn|insurance|ausweis\w*|pasaporte|passeport|dni|nie|паспорт\w*)(?:[ ,:]*(?:cu|so|no\.?|number|nummer|la|cua minh|numero|de|is)?)*[ ,:]*$"), regex.I)
NUMBER_END = regex.compile(r"^[)]?(?:[.,;!?…\n]|\s*$|です|입니다|。)", regex.I)
NUMBER_AGAINST = regex.compile(r"(?:#|isbn[ :]*|ma don hang |ma don |don hang |order (?:no\.? )?|ticket #?|bai so |tai khoan[^.]{0,40} |loi |tong cong |version |ver\.? ?|vol\.? )$", regex.I)
MONEY_AFTER = regex.compile(r"^ ?(?:d\b|dong|vnd|trieu|cu\b|k\b|luot|euros?|usd|%|円|元|บาท|원)", regex.I)
ADDRESS_BEFORE = regex.compile(skeleton(r"(?:\bo|\btai|\bdia chi(?: la)?|\bve|\blives? (?:at|on)|\bj'?habite(?: au)?|\bvivo en|\bwohne in der|\bwohne|\baddress(?: is)?|\bдоме|живу на)[ :]*$"), regex.I)
EMAIL_BEFORE = regex.compile(skeleton(r"(?:mail|thu|lien he|contact|address|write|schreib|escrib|ecri|пиш|연락|連絡)"))

EMAIL = regex.compile(
    r"(?<![\w.+%@\-])[a-z0-9][a-z0-9._%+\-]*(?:@|\s@\s|\s?[(\[{]\s?(?:at|@|a cong)\s?[)\]}]\s?|\s(?:a cong|at)\s(?=\S+\s(?:dot|cham)\s))[a-z0-9][a-z0-9\-]*(?:(?:\.|\s\.\s|\s?[(\[{]\s?(?:dot|\.|cham)\s?[)\]}]\s?|\s(?:dot|cham)\s)[a-z][a-z0-9\-]*)+"
)
NUMBER = regex.compile(r"(?<![0-9a-z,/#])(?<!\d\.)[(]?[+]?[(]?[0-9o][0-9ol().\- ]{5,22}[0-9ol](?![0-9a-z/]|[.,]\d|-\d)")
WORDS = regex.compile(rf"(?<!\w)(?:{'|'.join(DIGIT_WORDS)})(?:[ \-]+(?:{'|'.join(DIGIT_WORDS)})){{6,13}}(?!\w)")
COUNTRY_ID = regex.compile(r"(?<!\w)(?:[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d]|[xyz]\d{7}[a-z]|[a-z]{1,2}\d{7,8})(?!\w)")
VIETNAMESE_STREET = regex.compile(r"(?<![\w,./])(?:so(?: nha)? )?\d{1,4}[a-z]?(?:/\d{1,4}[a-z]?)*(?: bis)?(?:,? (?:ngo|hem|ngach|kiet) \d{1,4}(?:/\d{1,4})*)*,? (?:duong |pho |d\. ?)\p{L}+(?: \p{L}+)?(?:,? (?:phuong \p{L}+|p\. ?\d+|quan \p{L}+(?: \p{L}+)?|q\. ?\d+))*")
WESTERN_STREET = regex.compile(
    r"(?<![\w,./])(?:(?:flat|apt|unit) \d+[a-z]?, )?\d{1,4}[a-z]? (?:old )?\p{L}+(?: \p{L}+)? (?:street|st|road|rd|lane|ln|avenue|ave|drive|court|close|way|boulevard|blvd)\b\.?(?:, (?:apt|flat|unit) \d+[a-z]?)?"
    r"|(?<![\w,./])\d{1,4}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|allee|chemin|impasse|quai) (?:de la |de l'|des |de |du |d')?\p{L}+"
    r"|(?<!\w)(?:calle|avenida|plaza|paseo|c/) ?(?:de (?:la )?)?\p{L}+,? \d{1,4}(?:, \d{1,2}º? ?[a-z]?)?"
    r"|(?<!\w)\p{L}+(?:strasse|straße|str\.|weg|gasse|platz|allee) \d{1,4}[a-z]?\b"
)
CAPS = regex.compile(r"(?<![\p{L}\p{M}@.\d'’_])\p{Lu}[\p{L}\p{M}'’]*(?:(?: \p{Lu}\.)? \p{Lu}[\p{L}\p{M}'’]+)+")
#: A family name with one or two middle names, in a text without capitals; a name after its context, in scripts without case.
LOWER_NAME = regex.compile(rf"(?<!\d )(?<![\p{{L}}\p{{M}}@._'’-])(?:{'|'.join(sorted(w for w in SURNAMES if len(w) > 2))})(?: (?:{'|'.join(sorted(MIDDLES - {'the', 'cong', 'thu', 'anh', 'bao'}))}))? \p{{L}}+(?: \p{{L}}+)?")
CASELESS = regex.compile(r"(?<=我叫|名叫|名字叫|我是)\p{Han}{2,4}(?=[，,。.！!\s]|$)|(?<=私は|名前は|僕は)[\p{Han}\p{Hiragana}\p{Katakana}ー・ ]{2,10}?(?=です|と申し)|(?<=이름은 |저는 |나는 )\p{Hangul}{2,4}(?=입니다|이에요|예요|이고|[.,]|$)")
_EDGE_LETTERS = regex.compile(r"^(?:[ol]+\s+)+|(?:\s+[ol]+)+$")
_NOT_DIGIT, _PLAIN_WORD, _NAME_WORD, _LETTERS = regex.compile(r"\D"), regex.compile(r"\w+"), regex.compile(r"[\p{L}\p{M}'’]+\.?"), regex.compile(r"[\p{L}\p{M}]+")
_NATIONAL = regex.compile(r"0[35789]\d{8}|(?:00)?84[35789]\d{8}|0[12]\d{8,9}")
_KNOWN = regex.compile(r"(?:\(?\d{3}\)?[ .\-])?\d{3}[.\-]\d{4}|\+?1[ .\-]\d{3}[ .\-]\d{3}[ .\-]?\d{4}|\+44 ?\d{4} ?\d{6}|07\d{3} ?\d{6}|0\d{2} \d{5} \d{3}|\+49.*|\+33.*|0\d(?: \d{2}){4}|\(?\+\d{1,3}\)?.*")
_SOCIAL, _NINE = regex.compile(r"\d{3}[ \-]\d{2}[ \-]\d{4}"), regex.compile(r"\d{9}|\d{3}([ .\-])\d{3}\1\d{3}")
_AT = regex.compile(r"\s?(?:@|[(\[{]\s?(?:at|@|a cong)\s?[)\]}]|\s(?:a cong|at)\s)\s?")
_HOST = regex.compile(r"[^a-z0-9\-]+")
_WHOLE = regex.compile(r"phuong|quan |p\. ?\d|q\. ?\d|apt|flat|bis|/\d|(?:ngo|hem) \d|º")
_UNIT = regex.compile(r" ?(?:km|m\b|phut|tieng|hours?|days?|miles?)")
_INITIAL = regex.compile(r"(?<=\p{Ll}) \p{Lu}\. \p{Lu}")
_RUNS = regex.compile(r"(\d+)|\p{L}+")
# One of these stands in every address that the patterns find.
_STREET_SIGNS = ("street", "st", "road", "rd", "lane", "ln", "ave", "drive", "court", "close", "way", "boul", "blvd", "rue", "place", "allee", "chemin", "impasse", "quai", "calle", "plaza", "paseo", "c/", "weg", "gasse", "platz")
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}]+|\d+|[^\s\p{L}\p{N}]")


def normal(text: str) -> tuple[str, Sequence[int]]:
    """(text in one form of characters, for each of them where it begins in the stored text, then the length)."""
    if text.isascii() or not (TRANSDUCER.search(text) or JOINERS[0] in text or JOINERS[1] in text):
        return text, range(len(text) + 1)
    out, at, last = [], [], 0

    def keep(piece: str, start: int) -> None:
        out.append(piece)
        at.extend(range(start, start + len(piece)))

    for m in TRANSDUCER.finditer(text):
        keep(text[last : m.start()], last)
        form = TABLE[m.group()]
        out.append(form)
        at.extend([m.start()] * len(form))
        last = m.end()
    keep(text[last:], last)
    joined, places = "".join(out), [*at, len(text)]
    if JOINERS[0] in joined or JOINERS[1] in joined:
        drop = {i for m in _JOINED.finditer(joined) for i in range(*m.span())}
        places = [p for i, p in enumerate(places) if i not in drop]
        joined = "".join(c for i, c in enumerate(joined) if i not in drop)
    return joined, places


class _Flat(dict):
    def __missing__(self, code: int) -> str:
        base = unicodedata.normalize("NFD", chr(code).lower())[:1] or chr(code)
        self[code] = {"đ": "d", "ı": "i"}.get(base, base)
        return self[code]


_FLAT = _Flat()


def flat(text: str) -> str:
    """Lower case without accents, character by character."""
    return text.lower() if text.isascii() else text.translate(_FLAT)


def _address_of_host(body: str) -> bool:
    parts = body.split(".")
    return len(parts) == 4 and all(p.isdigit() and p == str(int(p)) and int(p) < 256 for p in parts)


def _sign(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def _numbers(norm: str, low: str) -> Iterator[tuple]:
    """Phones and identity numbers: type, start, end, votes (format, before, after, against, shape)."""
    spans = [(m.start(), m.end()) for m in NUMBER.finditer(low)]
    spans += [(m.start(), m.end()) for m in WORDS.finditer(low)] + [(m.start(), m.end()) for m in COUNTRY_ID.finditer(low)]
    for a, b in spans:
        # letters that stand for digits have digits beside them
        body = _EDGE_LETTERS.sub("", low[a:b].strip()).rstrip(" .-(")
        if len(body) < 7:
            continue
        a = low.index(body, a)
        b = a + len(body)
        words = body[0].isalpha() and body.split()[0] in DIGIT_WORDS
        digits = "".join(DIGIT_WORDS.get(w, "") for w in _PLAIN_WORD.findall(body)) if words else _NOT_DIGIT.sub("", body.replace("o", "0").replace("l", "1"))
        if not 7 <= len(digits) <= 15 or sum(c.isdigit() for c in body) < 5 and not words:
            continue
        before, after = low[max(0, a - 40) : a], low[b : b + 30]
        if MONEY_AFTER.search(after) or _address_of_host(body) or digits.startswith(("978", "979")) and len(digits) == 13:
            continue  # an amount, an address of a host or the number of a book, by their forms
        against = NUMBER_AGAINST.search(before) is not None
        letters = not words and "a" <= body[0] <= "z" and COUNTRY_ID.fullmatch(body) is not None
        national = _NATIONAL.fullmatch(digits) is not None and not letters
        known = _KNOWN.fullmatch(body) is not None
        social = _SOCIAL.fullmatch(body) is not None
        identity = social or letters or len(digits) == 12 and digits[0] == "0" and not body.startswith("+")
        nine = len(digits) == 9 and _NINE.fullmatch(body) is not None
        id_near, phone_near = bool(ID_BEFORE.search(before)), bool(PHONE_BEFORE.search(before))
        ends = NUMBER_END.search(after) is not None
        if not letters and not social:
            yield "phone", a, b, (_sign(national or known, nine or len(digits) > 12), _sign(phone_near, id_near), _sign(ends, against), _sign(False, against), _sign(words or national or body[0] in "+(", identity or nine and not phone_near))
        if identity or nine or id_near:
            yield "id_number", a, b, (_sign(identity or nine and id_near, not nine), _sign(id_near, phone_near), _sign(ends, against), _sign(False, against), _sign(letters or identity and len(digits) in (9, 12) or nine, national and len(digits) == 10 or known and not identity))


def _emails(norm: str, low: str) -> Iterator[tuple]:
    for m in EMAIL.finditer(low):
        body = m.group()
        local, domain = _AT.split(body, maxsplit=1)
        top = _HOST.split(domain)[-1]
        near = EMAIL_BEFORE.search(low[max(0, m.start() - 40) : m.start()]) is not None
        yield "email", m.start(), m.end(), (_sign("@" in body and " " not in body), _sign(near), _sign(len(top) >= 2 and top.isalpha(), not top.isalpha()), _sign(False, not any(c.isalpha() for c in local)), _sign(len(local) > 2))


def _addresses(norm: str, low: str) -> Iterator[tuple]:
    patterns = [VIETNAMESE_STREET] if "duong " in low or "pho " in low or "d." in low else []
    patterns += [WESTERN_STREET] if any(sign in low for sign in _STREET_SIGNS) else []
    for pattern in patterns:
        for m in pattern.finditer(low):
            a, b = m.span()
            words = _LETTERS.findall(norm[a:b])
            named = any(w[0].isupper() for w in words)
            near = bool(ADDRESS_BEFORE.search(low[max(0, a - 30) : a]))
            whole = _WHOLE.search(m.group()) is not None
            unit = _UNIT.match(low[b : b + 10]) is not None
            yield "street_address", a, b, (_sign(named or norm.islower()), _sign(near), _sign(whole or low[b : b + 1] in ",.!"), _sign(False, unit), _sign(low[a].isdigit() or low[a : a + 2] == "so" or not pattern is VIETNAMESE_STREET))


_FLAT_SURNAMES = {flat(w) for w in SURNAMES if len(w) > 2} - {"lam"}


def _surname(word: str, following: str) -> bool:
    """Whether a word is a family name, as it stands or, before a middle name, written without accents."""
    return len(word) > 2 and word.lower() in SURNAMES or word.isascii() and word.lower() in _FLAT_SURNAMES and flat(following) in MIDDLES


def _name_spans(norm: str, low: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, has a Vietnamese family name) of possible names."""
    if norm.islower():
        for m in LOWER_NAME.finditer(norm):
            words = norm[m.start() : m.end()].split(" ")
            more = sum(1 for _ in itertools.takewhile(lambda w: flat(w) in MIDDLES, words[1:-1]))
            named = NAME_BEFORE.search(low[max(0, m.start() - 25) : m.start()]) is not None
            if more or named:
                size = min(len(words), 2 + more)
                yield m.start(), m.start() + len(" ".join(words[:size])), True
        return
    for m in CAPS.finditer(norm):
        a = m.start()
        words = [(w.start() + a, w.end() + a) for w in _NAME_WORD.finditer(m.group())]
        text = [norm[x:y].rstrip(".") for x, y in words]
        # a family name of the gazetteer may come after other words that have capitals
        start = next((i for i, (w, v) in enumerate(zip(text[:-1], text[1:], strict=True)) if _surname(w, v)), None)
        if start is not None:
            more = [flat(w) in MIDDLES for w in text[start + 1 : start + 3]]
            size = 4 if more == [True, True] and len(text) - start > 3 else 3 if more[:1] == [True] and len(text) - start > 2 else 2
            yield words[start][0], words[start + size - 1][1], True
            continue
        start = 0
        while start < len(text) - 2 and text[start].lower() in LEADS:
            start += 1
        if text[start].lower() in LEADS:
            continue
        if len(text) - start <= 4:
            yield words[start][0], words[-1][1], False
        else:  # a name may stand anywhere in a long run of capitalised words
            for i in range(start, len(text) - 1):
                for j in (i + 1, i + 2):
                    if j < len(text):
                        yield words[i][0], words[j][1], False


def _names(norm: str, low: str) -> Iterator[tuple]:
    for m in CASELESS.finditer(norm):
        yield "person_name", m.start(), m.end(), (0, 1, 0, 0, 1)
    seen = set()
    for first, end, surname in _name_spans(norm, low):
        if (first, end) in seen:
            continue
        seen.add((first, end))
        text = [w.rstrip(".") for w in norm[first:end].split(" ")]
        own = [flat(w) for w in text]
        before, after = low[max(0, first - 25) : first], low[end : end + 25]
        prior = _LETTERS.findall(before)
        prior_word = prior[-1] if prior else ""
        latin = norm[first:end].isascii()
        middle = len(own) > 2 and own[1] in MIDDLES
        near, behind = NAME_BEFORE.search(before) is not None, NAME_AFTER.search(after) is not None
        sentence = not before.strip() or before.rstrip()[-1:] in ".!?:\"\n…" or "\n" in before[-2:]
        shouted = norm[first:end].isupper()
        inside = not surname and (norm[end : end + 2].strip()[:1].isupper() or norm[max(0, first - 2) : first].strip()[-1:].isalpha() and norm[: first].rstrip().rsplit(" ", 1)[-1][:1].isupper() and prior_word not in LEADS)
        place = prior_word in PLACE_BEFORE and prior[-2:] != ["hom", "qua"] and not near or own[-1] in STREETS
        titled = any(w in TITLES for w in own) and not surname or prior_word in TITLES and not (surname or near)
        initial = _INITIAL.search(norm[first:end]) is not None
        yield (
            "person_name",
            first,
            end,
            (
                _sign(surname and (middle or near or behind or len(own) == 2 and not latin and not shouted) or initial and not titled, not surname and not latin),
                _sign(near and not titled),
                _sign(behind and not titled),
                _sign(False, place or titled or shouted and not (surname and middle or near and not surname) or inside and not near),
                _sign(surname and not place, sentence and not surname and not (near or behind) or len(own) > 3 and not surname),
            ),
        )


def candidates(norm: str) -> list[tuple]:
    """(type, start, end, votes, places of the words inside and around) of a text in one form."""
    low, out = flat(norm), []
    for find in (_emails, _numbers, _addresses, _names):
        for kind, a, b, votes in find(norm, low):
            around = _TOKEN.findall(low[max(0, a - 40) : a])[-AROUND:]
            behind = _TOKEN.findall(low[b : b + 40])[:AROUND]
            inside = [w for w in _TOKEN.findall(low[a:b]) if w.isalpha()][:6] if kind == "person_name" else []
            features = [f"b{i}{w}" for i, w in enumerate(reversed(around))] + [f"a{i}{w}" for i, w in enumerate(behind)] + [f"w{i}{w}" for i, w in enumerate(inside)]
            shape = _RUNS.sub(lambda m: "9" if m.group(1) else "a", low[a:b])[:12]
            features += [f"s{shape}", "all"]
            out.append((kind, a, b, list(votes), [zlib.crc32(f"{kind}{f}".encode()) % PLACES for f in features]))
    return out


def _found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for key, text in zip(frame.key, frame.text, strict=True):
            norm, at = normal(text)
            for kind, a, b, votes, features in candidates(norm):
                last = at[b - 1]
                # up to where the next kept character begins, without what has no width behind the span
                end = next((at[i] for i in range(b, len(at)) if at[i] > last), at[-1])
                out.append((key, kind, at[a], end, votes, features))
        yield pd.DataFrame(out, columns=["key", "kind", "start", "end", "votes", "features"])


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[np.ndarray, float, dict]:
    """EM over (votes, count) of one type: chances (truth, labeler, vote + 1), share of true spans, chance by pattern.

    Dirichlet priors of a tenth of the candidates keep a labeler's yes a yes.
    """
    votes = np.array([p for p, _ in patterns]) + 1
    n = np.array([c for _, c in patterns], float)
    total = n.sum()
    prior = np.array([[4.0, 3.0, 0.5], [0.5, 3.0, 4.0]])[:, None, :] * np.ones((2, votes.shape[1], 1))
    prior *= 0.1 * total / prior.sum(-1, keepdims=True)
    q = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(1).astype(float)))
    chances, share = None, 0.5
    for _ in range(rounds):
        chances = prior.copy()
        for truth, weight in ((0, n * (1 - q)), (1, n * q)):
            for j in range(votes.shape[1]):
                np.add.at(chances[truth, j], votes[:, j], weight)
        chances /= chances.sum(-1, keepdims=True)
        share = ((n * q).sum() + 0.05 * total) / (1.1 * total)
        score = np.log(share / (1 - share)) + sum(np.log(chances[1, j, votes[:, j]] / chances[0, j, votes[:, j]]) for j in range(votes.shape[1]))
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return chances, share, {p: float(s) for (p, _), s in zip(patterns, q, strict=True)}


def _clear(found: list) -> list:
    """Of spans (with start, end and chance) those that stay, in order: the more likely, then the longer, then the first."""
    kept: list = []
    starts: list[int] = []
    for r in sorted(found, key=lambda r: (-r["chance"], r["start"] - r["end"], r["start"], r["kind"])):
        i = bisect.bisect_left(starts, r["start"])
        if (i == 0 or kept[i - 1]["end"] <= r["start"]) and (i == len(kept) or kept[i]["start"] >= r["end"]):
            kept.insert(i, r)
            starts.insert(i, r["start"])
    return kept


def spans(documents: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """key, kind, start, end (code points of the stored text), chance of every accepted span; no two of a document overlap.

    key must be unique. To the driver go the counts of vote patterns (at most 3 ** LABELERS a type) and at most sample
    candidates a type (those with the lowest hashes), on which the classifier is trained.
    """
    spark = documents.sparkSession
    rows = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull() & (F.col("text") != "")))
    kind = rows.schema["key"].dataType.simpleString()
    found = stored(rows.mapInPandas(_found, f"key {kind}, kind string, start int, end int, votes array<int>, features array<int>"), "spans")
    counts = found.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    chances = []
    for name in TYPES:
        patterns = [(tuple(r.votes), r.n) for r in counts if r.kind == name]
        if patterns:
            chances += [(name, list(p), q) for p, q in reliabilities(patterns)[2].items()]
    table = spark.createDataFrame(chances, "kind string, votes array<int>, q double")
    judged = found.join(F.broadcast(table), ["kind", "votes"])
    # a share of the hashes that holds the sample of the most frequent type; the few above it are cut by the limit
    most = max((sum(r.n for r in counts if r.kind == name) for name in TYPES), default=0)
    order = F.pmod(F.xxhash64("key", "start", "end"), F.lit(1 << 30))
    drawn = judged.filter(order < int((1 << 30) * min(1.0, sample / max(1, most)))) if most > sample else judged
    taught = drawn.select("features", "q").toPandas()
    weights = spark.sparkContext.broadcast(train(list(taught.features), taught.q.to_numpy(float), PLACES))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            learnt = np.array([weights.value[np.asarray(f)].sum() for f in frame.features]) if len(frame) else np.array([])
            q = frame.q.clip(1e-6, 1 - 1e-6)
            score = (1 - SHARE) * np.log(q / (1 - q)) + SHARE * learnt
            frame = frame.assign(chance=1 / (1 + np.exp(-score)))
            yield frame.loc[frame.chance > 0.5, ["key", "kind", "start", "end", "chance"]]

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,chance:double>>")
    def cleared(all_found: pd.Series) -> pd.Series:
        return pd.Series([_clear(list(spots)) for spots in all_found])

    good = judged.mapInPandas(decide, f"key {kind}, kind string, start int, end int, chance double")
    by = good.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end", "chance")).alias("found"))
    return by.select("key", F.explode(cleared("found")).alias("r")).select(F.col("key").alias(key), "r.*")


def redact(documents: DataFrame, key: str = "doc_id", text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """key, text with [EMAIL], [PHONE], [ID_NUMBER], [STREET_ADDRESS] and [PERSON_NAME] in place of the spans.

    key must be unique; a document's spans are no more than its text has room for.
    """
    found = spans(documents, key, text) if found is None else found
    by = found.groupBy(key).agg(F.collect_list(F.struct("start", "end", "kind", "chance")).alias("found"))
    rows = documents.select(F.col(key), F.col(text).alias("text")).join(by, key, "left")

    @F.pandas_udf("string")
    def replace(texts: pd.Series, all_found: pd.Series) -> pd.Series:
        out = []
        for t, spots in zip(texts, all_found, strict=True):
            if t is not None and spots is not None and len(spots):
                parts, last = [], 0
                for r in _clear(list(spots)):
                    parts += [t[last : r["start"]], f"[{r['kind'].upper()}]"]
                    last = r["end"]
                t = "".join([*parts, t[last:]])
            out.append(t)
        return pd.Series(out)

    return rows.select(key, replace("text", "found").alias("text"))
