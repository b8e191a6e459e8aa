import pytest

from florilege.llm.encoding import damaged_texts, restore

TEXTS = {
    "de": "Während der Trocknung ging ein Teil verloren. Größere Gefäße standen über Nacht kühl – “so” blieb es.",
    "fr": "L’échantillon prélevé près du lac n’a révélé aucune trace ; la forêt s’éclaircit où il gèle.",
    "es": "¿Por qué falta en la raíz? Aún no está claro. La extracción duró más de lo previsto en otoño.",
    "pl": "Część próbek zamarzła, więc ich wyniki pominięto. Stężenie wzrosło, choć była duża różnica.",
    "pt": "NO ÂMBITO DA CRIAÇÃO NÃO FOI AVALIADA. A coleção reúne amostras; às vezes a solução fica turva.",
    "ru": "Растение чаще встречается на влажных лугах. Корни собирали весной, когда почва ещё холодная.",
    "en": "Costs came to € 48 at 20.5 ± 0.05 min, 3 µm × 2 cm² or 6 Å (see α-pinene, Velbo™).",
}


@pytest.mark.parametrize("lang", TEXTS)
def test_clean_texts_are_left_alone(lang):
    assert restore(TEXTS[lang]) is None
    assert restore(TEXTS[lang].upper()) is None


def western(data):
    return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in data)


@pytest.mark.parametrize("lang", TEXTS)
@pytest.mark.parametrize("wrong", ["latin-1", "western", "mac_roman", "cp437", "cp1251"])
def test_multibyte_round_trip(lang, wrong):
    data = TEXTS[lang].encode()
    read = western if wrong == "western" else lambda b: b.decode(wrong, "strict")
    try:
        text = read(data)
    except UnicodeDecodeError:
        pytest.skip("the encoding has no character for a byte")
    got = restore(text)
    assert got is not None and "multibyte" in got.by
    if not (wrong == "cp1251" and lang not in ("ru", "en")):
        assert got.text == TEXTS[lang] and got.fully_restored


def test_twice_and_in_places():
    twice = western(western(TEXTS["fr"].encode()).encode())
    assert restore(twice).text == TEXTS["fr"]
    part = TEXTS["de"] + "\n" + western(TEXTS["es"].encode())
    assert restore(part).text == TEXTS["de"] + "\n" + TEXTS["es"]


@pytest.mark.parametrize(("lang", "written", "read"), [("ru", "cp1251", "western"), ("ru", "cp1251", "koi8-r"), ("pl", "iso8859-2", "western"), ("pl", "cp1250", "western"), ("fr", "mac_roman", "western"), ("es", "cp850", "western"), ("de", "mac_roman", "western")])
def test_one_byte_round_trip(lang, written, read):
    data = TEXTS[lang].replace("–", "-").replace("“", "").replace("”", "").replace("’", "'").encode(written)
    text = western(data) if read == "western" else data.decode(read)
    got = restore(text)
    assert got is not None and got.text == data.decode(written) and got.by[0] == "single byte"


def test_lost_bytes():
    got = restore("Im Mai bl�hte es")
    assert got.damage == ("bytes lost",) and got.text == "Im Mai bl�hte es" and not got.fully_restored


def test_any_number_of_layers():
    text = TEXTS["fr"]
    for _ in range(11):
        text = western(text.encode())
    got = restore(text)
    assert got.text == TEXTS["fr"] and got.fully_restored


@pytest.mark.parametrize("text", ["Universitatea din București și Timișoara", "Ελλάδα: τα φυτά μεγαλώνουν", "中文植物化学", "النباتات الطبية", "Đặc điểm của rễ cây", "हिन्दी में पौधे"])
def test_scripts_outside_the_expected_languages(text):
    assert restore(text) is None or not restore(text).by == ("multibyte",)
    got = restore(western(text.encode()))
    assert got is not None and got.text == text


def test_controls_are_reported():
    got = restore("un \x93très\x94 noté")
    assert got.text == "un “très” noté" and got.damage == ("cp1252 read as latin-1",) and got.fully_restored
    got = restore("x\x81\x8d\x9dZy 12")
    assert "controls" in got.by


def test_what_stays_damaged_is_not_called_restored():
    got = restore(western("größer".encode()) + " und � und \x9d")
    assert got.text.startswith("größer") and not got.fully_restored


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "plain"), (4, western("é à".encode()) + " x" * 100_000), (5, TEXTS["ru"]), (6, "bl�hte")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, damage string")
    got = {r["doc_id"]: (r["restored_text"][:3], r["fully_restored"]) for r in damaged_texts(df).collect()}
    assert got == {4: ("é à", True), 6: ("bl�", False)}
    assert damaged_texts(df.limit(0)).count() == 0
