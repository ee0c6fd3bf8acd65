"""Round-trip repair of text that was decoded with the wrong character encoding.

Plain Python over single strings, so that it can be tested without Spark; the
operator in ``mojibake.py`` runs it inside Arrow batches.
"""

from __future__ import annotations

import re
from math import log

# Encodings a text is likely to have been misread in, and the ones it is likely to be in.
MISREAD_AS = ("cp1252", "latin-1", "cp1251", "cp1250", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "gbk", "big5", "shift_jis")
LEGACY = ("cp1252", "cp1251", "koi8-r", "gbk", "euc_jp", "shift_jis", "mac_roman", "cp850", "cp866", "big5")
CJK = ("gbk", "euc_jp", "shift_jis", "big5")

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_ACC = "À-ÖØ-öø-ÿĀ-ž"
_CYR = "Ѐ-ӿ"
_HAN = "㐀-鿿豈-﫿"
_BOX = "─-▟"
_SYM = "¡-ª¬®-¶¸-º¼-¿×÷ƒ€‚„†‡ˆ‰‹›˜™•¬∀-⋿◊ˇ˘-˝№⌐⌠⌡₧ﬁﬂ⁄" + _BOX
_TRAIL = "\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"

# (pattern, weight): what correct text hardly ever holds.
_RULES = tuple(
    (re.compile(p), w)
    for p, w in (
        ("[\u0080-\u009f]", 2.0),  # C1 controls
        ("[-]", 2.0),  # private use
        (f"(?<=[{_LATIN}{_CYR}])[{_SYM}](?=[{_LATIN}{_CYR}])", 1.0),  # a symbol inside a word
        (f"[À-ßĂĹĽÄ][{_TRAIL}]", 1.0),  # lead and trail byte of a two-byte sequence
        (f"[à-ïă][{_TRAIL}]{{2}}", 1.5),
        (f"[ðđ][{_TRAIL}]{{3}}", 2.0),
        (f"[a-zà-öø-ÿ](?=[À-ÖØ-Þ])", 1.0),  # upper case inside a lower-case word
        (f"(?<=[A-ZÀ-Þ])[à-ÿšœž](?=[A-ZÀ-Þ])", 1.0),
        ("[а-яёђѓєіїјљњћќўџ](?=[А-ЯЁЀ-Џ])", 1.0),
        (f"[{_LATIN}](?=[{_CYR}])|[{_CYR}](?=[{_LATIN}])", 1.0),  # two scripts in a word
        (f"[A-Za-z](?=[Ͱ-Ͽ])|[Ͱ-Ͽ](?=[A-Za-z])", 1.0),
        (f"[{_CYR}](?=[ -ª¬-º¼-¿‚„†‡‰‹›№€™•])|[ -ª¬-º¼-¿‚†‡‰‹№€™](?=[{_CYR}])", 1.0),
        ("[ЂЃ-ЏђѓљњћќўџҐґҒ-ӿ]", 0.4),  # Cyrillic outside Russian
        (f"(?![{_BOX}])[{_LATIN}0-9{_CYR}{_SYM}](?=[{_BOX}])|[{_BOX}](?=[{_LATIN}0-9{_CYR}])", 1.0),
        ("[╒╓╕╖╘╙╛╜╞╟╡╢╤╥╧╨╪╫▀▄▌▐░▒▓](?=[─-▟])|[─-▟](?=[╒╓╕╖╘╙╛╜╞╟╡╢╤╥╧╨╪╫▀▄▌▐])", 0.5),
        ("[㄀-ㄯ㈀-㋿︐-﹯ｦ-ﾟ]", 0.6),
        ("[ƀ-˅ˉ-˿̀-ͯ҃-ӿ԰-ࣿऀ-᷿Ⰰ-ⷿꀀ-꯿]", 0.7),
        (f"(?![{_BOX}])[{_SYM}](?=[{_SYM}])|[{_BOX}](?=(?![{_BOX}])[{_SYM}])", 0.5),
        (f"[‘“](?=[”’{_SYM}])", 0.3),
        (f"[Ͱ-Ͽ](?=[{_SYM}À-ÿ])|[{_SYM}À-ÿ](?=[Ͱ-Ͽ])", 1.0),
        (f"[{_ACC}](?=[{_SYM}])|(?<=[{_SYM}])[{_ACC}]", 0.5),
        (f"[　-ヿ{_HAN}](?=[{_SYM}{_ACC}{_CYR}])|[{_SYM}{_ACC}{_CYR}](?=[぀-ヿ{_HAN}])", 0.8),
        ("(?<=[^\\W\\d_])­|­(?=[^\\W\\d_])", 0.5),
    )
)
_PAIR = re.compile(f"(?=([{_ACC}][{_ACC}]))")
# Accented letters that do stand side by side in the languages at hand.
_USUAL_PAIR = re.compile("[çÇ][ãõàáâêéôóãÃÕÁ]|[éÉèÈ][éÉèÈêë]|[äöüÄÖÜ]ß|[ñÑ][áéíóúÁÉÍÓÚ]|[íÍ][óáÓ]|ïé|œê|ãç|üí|áí|óí|ř[áíéý]|ý[áéíř]|šť|žď|ěš|éš|íč|Üß|ÃO|ĄŻ|żó|łą|łę|ół|śł|ść")
_HAN_RE = re.compile(f"[{_HAN}]")
_HAN_RUN = re.compile(f"[{_HAN}]+")
_LETTER = re.compile(r"[^\W\d_]")
_NEXT_TO = re.compile(f"[{_HAN}](?=[A-Za-z0-9{_ACC}])|(?<=[A-Za-z0-9{_ACC}])[{_HAN}]")
_LOST = re.compile("�+")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
#: Where a text only quotes or names garbled characters: inside code quotes of up to 24 characters (longer ones hold text), or the replacement character called by its name.
_QUOTED = re.compile(r"(?<!`)`[^`\n]{1,24}`(?!`)|�(?=['\"”’»)\]]?\s*\(?U\+FFFD)|(?<=U\+FFFD )[(\"'“]?�|(?<=U\+FFFD, )�|['\"“‘«]�['\"”’»]", re.I)


#: ASCII further than two characters from any other, which no rule looks at.
_PLAIN = re.compile(r"(?<=[\x00-\x7f]{2})[\x00-\x7f]+(?=[\x00-\x7f]{2})")


_rarity: dict[str, float] = {}


def _rare_han(ch: str) -> float:
    """0 for the hanzi or kanji of everyday text (level 1 of GB 2312 or JIS X 0208), more for rarer ones."""
    if ch not in _rarity:
        _rarity[ch] = _rarity_of(ch)
    return _rarity[ch]


def _rarity_of(ch: str) -> float:
    for codec, last in (("gb2312", 0xD7), ("euc_jp", 0xCF)):
        try:
            b = ch.encode(codec)
            if len(b) == 2 and 0xB0 <= b[0] <= last:
                return 0.0
        except UnicodeEncodeError:
            pass
    try:
        ch.encode("gb2312")
        return 0.35
    except UnicodeEncodeError:
        return 0.6


def mask_quotes(text: str) -> str:
    """The text with quoted characters blanked, at equal length."""
    return _QUOTED.sub(lambda m: "\x01" * len(m[0]), text)


def cost(text: str, mostly_han: bool = False) -> float:
    """How garbled a text looks; 0 for text that reads correctly. Lost characters count where they stand."""
    if text.isascii():
        return 0.0
    return _cost_of_word(text, mostly_han) if len(text) <= 48 else _cost(_PLAIN.sub(" ", text), mostly_han)


def _cost(text: str, mostly_han: bool) -> float:
    total = 2.0 * len(_LOST.findall(text))
    for pattern, weight in _RULES:
        found = pattern.findall(text)
        if found:
            total += weight * len(found)
    for pair in _PAIR.findall(text):
        if not _USUAL_PAIR.fullmatch(pair):
            total += 1.0
    han = _HAN_RE.findall(text)
    if han:
        total += sum(map(_rare_han, han))
        if not mostly_han:
            total += len(_NEXT_TO.findall(text))
    return total


#: The same words come back in many texts, and in every grain of one. Plain dicts, as this module is sent by value.
_costs: dict[tuple[str, bool], float] = {}
KEPT = 1 << 17


def _cost_of_word(text: str, mostly_han: bool) -> float:
    found = _costs.get((text, mostly_han))
    if found is None:
        if len(_costs) >= KEPT:
            _costs.clear()
        found = _costs[text, mostly_han] = _cost(text, mostly_han)
    return found


def _encode(piece: str, codec: str) -> bytes | None:
    """Bytes of a piece in a legacy encoding; positions that cp125x leave open stand for their C1 control."""
    try:
        return piece.encode(codec)
    except UnicodeEncodeError:
        if codec not in ("cp1252", "cp1251", "cp1250"):
            return None
    out = bytearray()
    for ch in piece:
        try:
            out += ch.encode(codec)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) <= 0x9F:
                return None
            out.append(ord(ch))
    return bytes(out)


def _decode(raw: bytes, codec: str, lost: bool) -> str | None:
    """Strict decoding; where a lost character stands beside the piece, a sequence may break off there."""
    try:
        return raw.decode(codec)
    except UnicodeDecodeError as e:
        if lost and codec == "utf-8" and e.reason == "unexpected end of data" and e.start:
            try:
                return raw[: e.start].decode(codec) + "�"
            except UnicodeDecodeError:
                pass
    return None


def _readings(piece: str, lost: bool, utf8: bool):
    """Every (wrong, right, text) that strict decoding allows, to UTF-8 or to the other encodings."""
    seen = set()
    for wrong in MISREAD_AS:
        raw = _encode(piece, wrong)
        if raw is None or raw.isascii() or raw in seen:
            continue
        seen.add(raw)
        if utf8:
            text = _decode(raw, "utf-8", lost)
            if text is not None:
                yield wrong, "utf-8", text
            continue
        multi = wrong in ("gbk", "big5", "shift_jis")
        for right in () if multi else LEGACY:
            if right != wrong and (text := _decode(raw, right, False)) is not None:
                yield wrong, right, text


def _best(before: str, piece: str, after: str, han: bool, utf8: bool):
    """The reading of a piece at which its cost in place drops most, or None."""
    old = cost(before + piece + after, han)
    if old <= 0:
        return None
    # a change between legacy encodings is nearly always possible, so it has to explain more
    least, best = (0.3 if utf8 else max(0.9, 0.5 * old)), None
    for wrong, right, text in _readings(piece, after[:1] == "�", utf8):
        if not text.isprintable() and any(ch < " " and ch not in "\n\t\r" for ch in text):
            continue
        new = cost(before + text + after, han or (not utf8 and right in CJK))
        if new + least <= old and (best is None or new < best[0]):
            best = (new, wrong, right, text, old - new)
            if new == 0:
                break
    return best


_GRAINS = (re.compile(r"(?s).+"), re.compile(r"[^\n]+"), re.compile(r"[^.!?。！？\n]+"), re.compile(r"\S+"), re.compile(r"[^\x00-\x7f]+[@-~](?=[^\x00-\x7f])|[^\x00-\x7f]+"), re.compile(r"[^\x00-\x7f]"))
_EAST = re.compile(f"[{_HAN}぀-ヿ]")


def _mostly_east(text: str) -> bool:
    return len(_EAST.findall(text)) * 4 > len(_LETTER.findall(text))


def _pass(text: str, steps: list[str], utf8: bool) -> tuple[str, bool]:
    """One layer, from the whole text down to single characters."""
    changed = False
    for grain in _GRAINS:
        masked = mask_quotes(text)
        han = _mostly_east(masked)
        if cost(masked, han) <= 0:
            break
        out, at = [], 0
        for m in grain.finditer(masked):
            piece = m[0]
            if piece.isascii() or "\x01" in piece:
                continue
            a, b = m.span()
            found = _best(masked[max(0, a - 2) : a], piece, masked[b : b + 2], han, utf8)
            if found:
                out += [text[at:a], found[3]]
                at, changed = b, True
                steps.append(f"{found[1]}>{found[2]}")
        if out:
            text = "".join(out) + text[at:]
    return text, changed


# KOI8-R and CP1251 keep Cyrillic letters at the same bytes in the other case: a lower-case word read in the wrong one becomes an
# all-capital word that no rule above looks at. Letters per thousand of Russian text tell such a word from a real one.
_CAPITALS = re.compile("(?<![^\\W_])[А-ЯЁЈ]{4,}(?![^\\W_])")
_SMALL = re.compile("(?<![^\\W_])[а-яё]{4,}(?![^\\W_])")
_OFTEN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 84, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 9.7, 9.4, 7.3, 6.4, 4.8, 3.6, 3.2, 2.6, 0.4, 2)))
#: What Russian words do not hold: a sign or ы at the beginning or after a vowel or sign, й after a consonant or sign.
_NEVER = re.compile("^[ьъы]|[бвгджзйклмнпрстфхцчшщьъ]й|[аеёийоуыьъэюя][ьъы]")
#: Pairs that make up most of Russian text.
_PAIRS = frozenset("ст но ен то на ов ни ра во ко ро по пр ре ос го не ли ал от та ол ер ва ор ел ка ль ло ан ом ти ет ит те ат ла ес ин ле он де об ри ть из ам ир ил ем да за ис до ск тр ог ий ой ый ая ые ых их им ми ся ак ас ек ев ве ви ед ди ав ик ия ие ки ма ме мо ну ны ок од оп от па пе пи ру ры са се си со ты ту уд ут чи ча че ше ши ща яе яв ют ет ют аз ап ад бо бе бы ви вы вс га гр дн др ду еж жд же жи зн зо ив иц ле лу лю нн ня ож ой оч рм рн рт ря сл см сп ся тн уж ур ус уч хо це щи эт ящ".split())
#: Log odds from which a word is taken as garbled by itself, and beside another such word of its text.
ALONE, BESIDE = 10.0, 5.0
#: What it adds that the text has the reading, and not the word, in lower case elsewhere.
ELSEWHERE = 7.0


def _likely(word: str) -> float:
    pairs = sum(word[i : i + 2] in _PAIRS for i in range(len(word) - 1))
    return sum(log(_OFTEN.get(ch, 0.1)) for ch in word) - 3.0 * len(_NEVER.findall(word)) + 2.0 * pairs


def _lower_case(text: str) -> tuple[str, list[str], float]:
    """The text with all-capital words that are much more likely lower-case ones of the other encoding, steps, and a cost of 1 for each."""
    words = list(_CAPITALS.finditer(text))
    if not words:
        return text, [], 0.0
    lower = set(_SMALL.findall(text))
    best: tuple[list, str] = ([], "")
    for wrong, right in (("cp1251", "koi8-r"), ("koi8-r", "cp1251")):
        odds = []
        for m in words:
            raw = _encode(m[0], wrong)
            reading = raw and _decode(raw, right, False)
            if reading and reading.islower():
                odds.append((_likely(reading) - _likely(m[0].lower()) + ELSEWHERE * ((reading in lower) - (m[0].lower() in lower)), m, reading))
        if any(o[0] >= ALONE for o in odds):
            some = [o for o in odds if o[0] >= BESIDE]
            if sum(o[0] for o in some) > sum(o[0] for o in best[0]):
                best = (some, f"{wrong}>{right}")
    if not best[0]:
        return text, [], 0.0
    out, at = [], 0
    for _, m, reading in best[0]:
        out += [text[at : m.start()], reading]
        at = m.end()
    return "".join(out) + text[at:], [best[1]], float(len(best[0]))


def repair(text: str):
    """(restored text, steps, cost before, cost after). Quoted garbling stays as it is."""
    if text.isascii():
        return text, "", 0.0, 0.0
    masked = mask_quotes(text)
    first = cost(masked, _mostly_east(masked))
    steps: list[str] = []
    if first <= 0:
        return _finish(text, steps, first)
    before = first
    while before > 0:  # one layer at a time, as many as there are
        fixed, changed = _pass(text, steps, True)
        if not changed:
            fixed, changed = _pass(text, steps, False)
        if not changed:
            break
        masked = mask_quotes(fixed)
        left = cost(masked, _mostly_east(masked))
        text = fixed
        if left >= before:
            break
        before = left
    return _finish(text, steps, first)


def _finish(text: str, steps: list[str], first: float):
    """What ``repair`` gives, after a look at the text's capitals. Readings keep a text's length, so quotes are put back by place."""
    masked = mask_quotes(text)
    fixed, more, drop = _lower_case(masked)
    if more:
        text = "".join(old if m == "\x01" else new for old, m, new in zip(text, masked, fixed))
    elif first <= 0:
        return text, "", 0.0, 0.0
    masked = mask_quotes(text)
    return text, ",".join(dict.fromkeys(steps + more)), first + drop, cost(masked, _mostly_east(masked))


#: Cost that has to have gone by repair, or to be left, before a text counts as garbled.
LEAST_DROP, LEAST_LEFT = 0.3, 0.9


def judge(text: str | None):
    """(garbled, restored, steps, cost_before, cost_after) of one text; empty and null texts are not garbled."""
    if not text:
        return False, text, "", 0.0, 0.0
    fixed, steps, before, after = repair(text)
    garbled = bool(steps) and before - after >= LEAST_DROP or after >= LEAST_LEFT
    return garbled, fixed, steps, before, after
