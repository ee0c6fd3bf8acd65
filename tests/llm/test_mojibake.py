import pytest

from runloom.llm.encoding_kernel import judge

SENTENCES = ["Die Übergabe prüft die Größe der Anfrage, während das Gerüst läuft.", "L’étape écrase la clé d’accès dès la première séance.", "A sessão repetirá a configuração antiga após o reinício.", "Проверка меняет весь буфер в тихом режиме.", "日志关闭了下一行，评分器重复最后一步。", "索引は二番目の段階で最後の手順を閉じる。"]
PAIRS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1250")]


def wrong(text, true, read):
    out = []
    for b in text.encode(true):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("text", SENTENCES)
@pytest.mark.parametrize("true,read", PAIRS)
def test_round_trip(text, true, read):
    bad = wrong(text, true, read)
    garbled, fixed, *_ = judge(bad)
    assert garbled and fixed == text
    twice = wrong(bad, "utf-8", "cp1252")
    assert judge(twice)[0]


@pytest.mark.parametrize("text", [*SENTENCES, "", None, "plain", "├── src └── tests ✅ 3/3", "Cost: 4 €, 34 °C, ±5 %. See §3 of Dvořák’s note…", "The viewer printed `Ã±` where `ñ` was meant.", "A lenient one writes � (U+FFFD) and goes on.", "— 好 —"])
def test_correct_text(text):
    assert judge(text)[:2] == (False, text)


@pytest.mark.parametrize("text", ["A fun��o ignora", "37 �C", "Cost: 4 鈧�, 37 掳C, 卤5 %.", "Schl³ssel ½kadane╗ lõdt die õu▀ere", "ðåæèìå ïóñòîé êàòàëîã", "ÆÀ·ÖÆ÷µÚ¶þ²½ÖØ¸´¿ÕÄ¿Â¼"])
def test_other_garbling(text):
    assert judge(text)[0]


@pytest.mark.parametrize("true,read", [("koi8-r", "cp1251"), ("cp1251", "koi8-r")])
@pytest.mark.parametrize("text", ["Планировщик закрывает весь буфер.", "удаляет каталог в тихом режиме", "Проверка меняет буфер, запрос меняет ключ."])
def test_lower_case_word_garbled_in_place(text, true, read):
    for word in ("закрывает", "каталог", "меняет"):
        if word in text:
            bad = text.replace(word, wrong(word, true, read), 1)
            assert bad != text and judge(bad)[:3] == (True, text, f"{read}>{true}")


@pytest.mark.parametrize("text", ["ВНИМАНИЕ: СТАРЫЙ КЛЮЧ, НОВЫЙ ИНДЕКС! Проверка ГОСТ, НАТО, СССР, ФГБУ, ЮНЕСКО, МХАТ.", "ПЛАНИРОВЩИК ХРАНИТ 842 × СТАРЫЙ КЛЮЧ!"])
def test_real_capitals(text):
    assert judge(text)[:2] == (False, text)


def test_as_many_layers_as_there_are():
    text = "Die Übergabe prüft die Größe der Anfrage."
    for _ in range(6):
        text = wrong(text, "utf-8", "latin-1")
    assert judge(text)[1] == "Die Übergabe prüft die Größe der Anfrage."
