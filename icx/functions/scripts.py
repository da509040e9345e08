"""Language and script dimensions.

The perturbation operators are script-aware: each script has a code-point range used
for span noise, and each language falls into one of three punctuation classes chosen
by the script suffix of its `lang_Script` code (Arab -> Arabic class, Latn/Cyrl ->
ASCII class, anything else -> Indic class). Everything here is derived from the fixed
values below by rule; per row it becomes CASE expressions over the language column,
or literals when the language is a plain string.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------
# Fixed values (must equal the studied setup for identical results).
#
# Script code-point ranges, half-open [lo, hi):
SCRIPT_RANGES = {
    "Latn": (0x0020, 0x0080),
    "Cyrl": (0x0400, 0x052F),
    "Deva": (0x0900, 0x0980),
    "Beng": (0x0980, 0x0A00),
    "Guru": (0x0A00, 0x0A80),
    "Gujr": (0x0A80, 0x0B00),
    "Orya": (0x0B00, 0x0B80),
    "Taml": (0x0B80, 0x0C00),
    "Telu": (0x0C00, 0x0C80),
    "Knda": (0x0C80, 0x0D00),
    "Mlym": (0x0D00, 0x0D80),
    "Sinh": (0x0D80, 0x0DFF),
    "Olck": (0x1C50, 0x1C7F),
    "Arab": (0x0600, 0x06FF),
}
# Extra punctuation code points of the Indic and Arabic classes (on top of ASCII):
INDIC_EXTRA = [0x0964, 0x0965, 0xAAF1, 0xAAF0, 0xABEB, 0xABEC, 0xABED, 0xABEE, 0xABEF, 0x1C7E, 0x1C7F]
ARABIC_EXTRA = [0x0609, 0x060A, 0x060C, 0x061E, 0x066A, 0x066B, 0x066C, 0x066D, 0x06D4]
# The ASCII part of every class is string.punctuation without the backslash (the
# backslash was swallowed as an escape when the class was written), while the
# fallback mark list used when a script has no marks of its own is all of
# string.punctuation, backslash included.
# Language names (lang_Script code and English name, one per line):
LANGUAGE_NAMES = """
ace_Arab Acehnese (Arabic script)
ace_Latn Acehnese (Latin script)
acm_Arab Mesopotamian Arabic
acq_Arab Ta’izzi-Adeni Arabic
aeb_Arab Tunisian Arabic
afr_Latn Afrikaans
ajp_Arab South Levantine Arabic
aka_Latn Akan
amh_Ethi Amharic
apc_Arab North Levantine Arabic
arb_Arab Modern Standard Arabic
arb_Latn Modern Standard Arabic (Romanized)
ars_Arab Najdi Arabic
ary_Arab Moroccan Arabic
arz_Arab Egyptian Arabic
asm_Beng Assamese
ast_Latn Asturian
awa_Deva Awadhi
ayr_Latn Central Aymara
azb_Arab South Azerbaijani
azj_Latn North Azerbaijani
bak_Cyrl Bashkir
bam_Latn Bambara
ban_Latn Balinese
bel_Cyrl Belarusian
bem_Latn Bemba
ben_Beng Bengali
bho_Deva Bhojpuri
bjn_Arab Banjar (Arabic script)
bjn_Latn Banjar (Latin script)
bod_Tibt Standard Tibetan
bos_Latn Bosnian
brx_Deva Bodo
bug_Latn Buginese
bul_Cyrl Bulgarian
cat_Latn Catalan
ceb_Latn Cebuano
ces_Latn Czech
cjk_Latn Chokwe
ckb_Arab Central Kurdish
crh_Latn Crimean Tatar
cym_Latn Welsh
dan_Latn Danish
deu_Latn German
dik_Latn Southwestern Dinka
doi_Deva Dogri
dyu_Latn Dyula
dzo_Tibt Dzongkha
ell_Grek Greek
eng_Latn English
epo_Latn Esperanto
est_Latn Estonian
eus_Latn Basque
ewe_Latn Ewe
fao_Latn Faroese
fij_Latn Fijian
fin_Latn Finnish
fon_Latn Fon
fra_Latn French
fur_Latn Friulian
fuv_Latn Nigerian Fulfulde
gla_Latn Scottish Gaelic
gle_Latn Irish
glg_Latn Galician
gom_Deva Konkani
grn_Latn Guarani
guj_Gujr Gujarati
hat_Latn Haitian Creole
hau_Latn Hausa
heb_Hebr Hebrew
hin_Deva Hindi
hne_Deva Chhattisgarhi
hrv_Latn Croatian
hun_Latn Hungarian
hye_Armn Armenian
ibo_Latn Igbo
ilo_Latn Ilocano
ind_Latn Indonesian
isl_Latn Icelandic
ita_Latn Italian
jav_Latn Javanese
jpn_Jpan Japanese
kab_Latn Kabyle
kac_Latn Jingpho
kam_Latn Kamba
kan_Knda Kannada
kas_Arab Kashmiri (Arabic script)
kas_Deva Kashmiri (Devanagari script)
kat_Geor Georgian
knc_Arab Central Kanuri (Arabic script)
knc_Latn Central Kanuri (Latin script)
kaz_Cyrl Kazakh
kbp_Latn Kabiyè
kea_Latn Kabuverdianu
khm_Khmr Khmer
kik_Latn Kikuyu
kin_Latn Kinyarwanda
kir_Cyrl Kyrgyz
kmb_Latn Kimbundu
kmr_Latn Northern Kurdish
kon_Latn Kikongo
kor_Hang Korean
lao_Laoo Lao
lij_Latn Ligurian
lim_Latn Limburgish
lin_Latn Lingala
lit_Latn Lithuanian
lmo_Latn Lombard
ltg_Latn Latgalian
ltz_Latn Luxembourgish
lua_Latn Luba-Kasai
lug_Latn Ganda
luo_Latn Luo
lus_Latn Mizo
lvs_Latn Standard Latvian
mag_Deva Magahi
mai_Deva Maithili
mal_Mlym Malayalam
mar_Deva Marathi
min_Arab Minangkabau (Arabic script)
min_Latn Minangkabau (Latin script)
mkd_Cyrl Macedonian
plt_Latn Plateau Malagasy
mlt_Latn Maltese
mni_Beng Meitei (Bengali script)
mni_Mtei Meitei (Meitei script)
khk_Cyrl Halh Mongolian
mos_Latn Mossi
mri_Latn Maori
mya_Mymr Burmese
nld_Latn Dutch
nno_Latn Norwegian Nynorsk
nob_Latn Norwegian Bokmål
npi_Deva Nepali
nso_Latn Northern Sotho
nus_Latn Nuer
nya_Latn Nyanja
oci_Latn Occitan
gaz_Latn West Central Oromo
ory_Orya Odia
pag_Latn Pangasinan
pan_Guru Eastern Panjabi
pap_Latn Papiamento
pes_Arab Western Persian
pol_Latn Polish
por_Latn Portuguese
prs_Arab Dari
pbt_Arab Southern Pashto
quy_Latn Ayacucho Quechua
ron_Latn Romanian
run_Latn Rundi
rus_Cyrl Russian
sag_Latn Sango
san_Deva Sanskrit
sat_Olck Santali
scn_Latn Sicilian
shn_Mymr Shan
sin_Sinh Sinhala
slk_Latn Slovak
slv_Latn Slovenian
smo_Latn Samoan
sna_Latn Shona
snd_Arab Sindhi
snd_Deva Sindhi (Devanagari)
som_Latn Somali
sot_Latn Southern Sotho
spa_Latn Spanish
als_Latn Tosk Albanian
srd_Latn Sardinian
srp_Cyrl Serbian
ssw_Latn Swati
sun_Latn Sundanese
swe_Latn Swedish
swh_Latn Swahili
szl_Latn Silesian
tam_Taml Tamil
tat_Cyrl Tatar
tel_Telu Telugu
tgk_Cyrl Tajik
tgl_Latn Tagalog
tha_Thai Thai
tir_Ethi Tigrinya
taq_Latn Tamasheq (Latin script)
taq_Tfng Tamasheq (Tifinagh script)
tpi_Latn Tok Pisin
tsn_Latn Tswana
tso_Latn Tsonga
tuk_Latn Turkmen
tum_Latn Tumbuka
tur_Latn Turkish
twi_Latn Twi
tzm_Tfng Central Atlas Tamazight
uig_Arab Uyghur
ukr_Cyrl Ukrainian
umb_Latn Umbundu
urd_Arab Urdu
uzn_Latn Northern Uzbek
vec_Latn Venetian
vie_Latn Vietnamese
war_Latn Waray
wol_Latn Wolof
xho_Latn Xhosa
ydd_Hebr Eastern Yiddish
yor_Latn Yoruba
yue_Hant Yue Chinese
zho_Hans Chinese (Simplified)
zho_Hant Chinese (Traditional)
zsm_Latn Standard Malay
zul_Latn Zulu
"""
# ---------------------------------------------------------------------------------

LANGUAGES = dict(line.split(" ", 1) for line in LANGUAGE_NAMES.strip().split("\n"))

ASCII_CLASS = [ord(c) for c in string.punctuation if c != "\\"]
FALLBACK_MARKS = list(string.punctuation)

LATIN, INDIC, ARABIC = 0, 1, 2
CLASS_POINTS = {
    LATIN: ASCII_CLASS,
    INDIC: ASCII_CLASS + INDIC_EXTRA,
    ARABIC: ASCII_CLASS + ARABIC_EXTRA,
}


def punct_class_of(language: str) -> int:
    if language.endswith("Arab"):
        return ARABIC
    if language.endswith("Latn") or language.endswith("Cyrl"):
        return LATIN
    return INDIC


def script_of(language: str) -> str:
    return language.split("_")[1] if "_" in language else ""


def span_pool(script: str, pclass: int) -> list[int]:
    """Replacement code points for span noise: the script range minus punctuation."""
    lo, hi = SCRIPT_RANGES.get(script, (0, 0))
    cls = set(CLASS_POINTS[pclass])
    return [cp for cp in range(lo, hi) if cp not in cls]


def mark_pool(script: str, pclass: int) -> list[str]:
    """Marks appended by punctuation_add: range ∩ class, else all ASCII marks."""
    lo, hi = SCRIPT_RANGES.get(script, (0, 0))
    cls = set(CLASS_POINTS[pclass])
    own = [chr(cp) for cp in range(lo, hi) if cp in cls]
    return own or list(FALLBACK_MARKS)


def class_regex(pclass: int) -> str:
    """The class as a regex character class valid in Java and RE2."""
    return "[" + "".join(r"\x{%X}" % cp for cp in CLASS_POINTS[pclass]) + "]"


# --- per-row parameters -------------------------------------------------------------

def _lang(language) -> Column:
    return language if isinstance(language, Column) else F.lit(language)


def pclass_col(language) -> Column:
    lang = _lang(language)
    return (
        F.when(lang.endswith("Arab"), F.lit(ARABIC))
        .when(lang.endswith("Latn") | lang.endswith("Cyrl"), F.lit(LATIN))
        .otherwise(F.lit(INDIC))
    )


def is_punct(cp: Column, pclass: Column) -> Column:
    """Whether code point `cp` is in punctuation class `pclass` (hash-set membership)."""
    return (
        F.when(pclass == LATIN, cp.isin(CLASS_POINTS[LATIN]))
        .when(pclass == INDIC, cp.isin(CLASS_POINTS[INDIC]))
        .otherwise(cp.isin(CLASS_POINTS[ARABIC]))
    )


def _per_script(language, build) -> Column:
    """CASE over the script suffix, `build(script, pclass)` -> Column.

    A script implies its punctuation class, so one branch per known script plus a
    class-only fallback for scripts without a range covers every language code.
    """
    if not isinstance(language, Column):
        return build(script_of(language), punct_class_of(language))
    script = F.element_at(F.split(language, "_"), -1)
    out = None
    for s in SCRIPT_RANGES:
        val = build(s, punct_class_of("x_" + s))
        out = F.when(script == s, val) if out is None else out.when(script == s, val)
    pc = pclass_col(language)
    fallback = F.when(pc == LATIN, build("", LATIN)).when(pc == ARABIC, build("", ARABIC)).otherwise(build("", INDIC))
    return out.otherwise(fallback)


def range_lo(language) -> Column:
    return _per_script(language, lambda s, c: F.lit(SCRIPT_RANGES.get(s, (0, 0))[0]))


def range_hi(language) -> Column:
    return _per_script(language, lambda s, c: F.lit(SCRIPT_RANGES.get(s, (0, 0))[1]))


def _char_array(chars: list[str]) -> Column:
    """Constant array of one-character strings from a single string literal."""
    if not chars:
        return F.array().cast("array<string>")
    return F.split(F.lit("".join(chars)), "")


def span_pool_col(language) -> Column:
    """Replacement pool as an array of one-character strings."""
    return _per_script(language, lambda s, c: _char_array([chr(cp) for cp in span_pool(s, c)]))


def mark_pool_col(language) -> Column:
    return _per_script(language, lambda s, c: _char_array(mark_pool(s, c)))


# --- language dimension ----------------------------------------------------------

LANG_SCHEMA = T.StructType(
    [
        T.StructField("code", T.StringType(), False),
        T.StructField("lang", T.StringType(), False),
        T.StructField("script", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
    ]
)


def languages(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    """`languages(code, lang, script, name)`; defaults to LANGUAGES."""
    mapping = mapping or LANGUAGES
    rows = [(c, c.split("_")[0], script_of(c), n) for c, n in sorted(mapping.items())]
    return spark.createDataFrame(rows, LANG_SCHEMA)


def language_name(code: str, mapping: dict[str, str] | None = None) -> str:
    """Plan-time lookup; unknown codes raise KeyError like a dictionary lookup."""
    return (mapping or LANGUAGES)[code]
