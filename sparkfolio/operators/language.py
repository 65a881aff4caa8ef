"""The language of a text by its short words, and how well a set of characters covers a language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The short words of each language, in the order that ties follow.
SHORT_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei",
    "en": "the of and to in is that for it as was with be by on not he this are or his from at which but have an they you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son aux mais comme été être elle ses leur nous vous",
    "es": "de la que el en y los del se las por un para con no una su al es lo como más pero sus le ya o fue este ha sí porque esta son entre cuando muy sin sobre",
    "it": "di e il la che in a per un del è non una da sono le si con i dei al come della nel più anche ma ha questo alla gli ci delle se",
    "nl": "de van het een en in is dat op te zijn voor met die niet aan er om ook als bij door maar uit dan wordt nog kan tot naar over hij",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito nos",
}
#: Characters that are read, words that a judgement needs, the share of short words and the lead over the second.
READ, WORDS, SHARE, LEAD = 200_000, 40, 0.08, 1.5
#: Letters beyond a to z that a language needs.
LETTERS = {
    "de": "äöüß", "en": "", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü", "it": "àèéìòù", "nl": "ëï", "pt": "áâãàçéêíóôõú", "da": "æøå", "sv": "åäö", "nb": "æøå", "fi": "äö",
    "pl": "ąćęłńóśźż", "cs": "áčďéěíňóřšťúůýž", "sk": "áäčďéíľĺňóôŕšťúýž", "hu": "áéíóöőúüű", "tr": "çğıöşü", "ro": "ăâîșț", "hr": "čćđšž", "sl": "čšž", "et": "äõöü", "lv": "āčēģīķļņšūž", "lt": "ąčęėįšųūž",
}
ALIASES = {"german": "de", "deutsch": "de", "ger": "de", "deu": "de", "english": "en", "eng": "en", "french": "fr", "fra": "fr", "fre": "fr", "spanish": "es", "spa": "es", "italian": "it", "ita": "it", "dutch": "nl", "nld": "nl", "portuguese": "pt", "por": "pt", "danish": "da", "swedish": "sv", "norwegian": "nb", "no": "nb", "finnish": "fi", "polish": "pl", "czech": "cs", "slovak": "sk", "hungarian": "hu", "turkish": "tr", "romanian": "ro", "croatian": "hr", "slovenian": "sl", "estonian": "et", "latvian": "lv", "lithuanian": "lt"}


def words_of(text: Column | str) -> Column:
    """The words of a text, letters only, in lower case."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.substring(c, 1, READ)), F.lit(r"\p{L}+"), F.lit(0))


def language(docs: DataFrame, *keys: str) -> DataFrame:
    """keys and detected, a language's code or null where the text is short or none clearly leads.

    Words meet a fixed table of short words, which is broadcast; each row of keys is summed up before the shuffle.
    """
    langs = list(SHORT_WORDS)
    by_word: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        for w in SHORT_WORDS[lang].split():
            by_word.setdefault(w, [0] * len(langs))[k] = 1
    short = docs.sparkSession.createDataFrame([(w, *v) for w, v in sorted(by_word.items())], "w string, " + ", ".join(f"{x} int" for x in langs))
    words = docs.select(*keys, F.explode_outer(words_of("text")).alias("w")).join(F.broadcast(short), "w", "left")
    sums = words.groupBy(*keys).agg(F.count("w").alias("n"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in langs))
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(F.col(x).alias("n"), F.lit(-k).alias("k"), F.lit(x).alias("lang")) for k, x in enumerate(langs)))))
    sums = sums.select(*keys, "n", ranked.alias("r"))
    sure = (F.col("n") >= WORDS) & (F.col("r")[0]["n"] >= SHARE * F.col("n")) & (F.col("r")[0]["n"] >= LEAD * F.col("r")[1]["n"])
    return sums.select(*keys, F.when(sure, F.col("r")[0]["lang"]).alias("detected"))


def lookup(name: str) -> str | None:
    """The code that a name, alias or tag stands for."""
    tag = name.strip().lower().replace("_", "-")
    for x in (tag, tag.split("-")[0]):
        if x in LETTERS:
            return x
        if x in ALIASES:
            return ALIASES[x]
    return None


def coverage(charsets: DataFrame) -> DataFrame:
    """For each row of charsets (name, chars) and each language: the letters that are missing and the share of those there."""
    spark = charsets.sparkSession
    needed = spark.createDataFrame([(k, sorted(set("abcdefghijklmnopqrstuvwxyz" + v))) for k, v in LETTERS.items()], "lang string, letters array<string>")
    both = charsets.select("name", F.split(F.lower("chars"), "").alias("own")).crossJoin(F.broadcast(needed))  # a row for each of a fixed list of languages
    missing = F.array_except("letters", "own")
    return both.select("name", "lang", F.array_join(missing, "").alias("missing"), (1 - F.size(missing) / F.size("letters")).alias("ratio"))
