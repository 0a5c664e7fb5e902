"""Text extraction in column functions. Titles and requests are cut into words, and the words are looked up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import clamp, half_up, once

# Words that decide, in the order in which they count. A phrase is its words with single spaces.

#: A bracket with one of these is no part of a title.
JUNK = [
    "official", "lyric", "lyrics", "video", "audio", "visualizer", "mv", "hd", "hq", "4k", "remaster", "remastered", "explicit", "clean",
    "music video", "color coded", "sub", "subtitulado", "español", "legendado", "prod", "directed",
]
#: What ends the name of a channel without being part of the artist's.
CHANNEL = ["topic", "vevo", "official", "music"]
GUESTS = ["feat", "ft"]
GUESTS_LOOSE = ["feat", "ft", "featuring", "with"]
GENRES = {
    "chill": ["lofi", "lo fi", "ambient", "acoustic", "ballad", "piano", "chillhop", "chill hop", "sleep", "study", "rain", "asmr", "instrumental"],
    "hiphop": ["hiphop", "hip hop", "trap", "rap", "drill", "boombap", "boom bap", "phonk", "grime", "r&b", "rnb"],
    "edm": [
        "edm", "house", "techno", "trance", "dubstep", "drum and bass", "drumandbass", "dnb", "d&b", "electro", "future bass", "hardstyle",
        "big room", "progressive", "deep house", "tech house", "festival", "remix", "bootleg", "club mix", "extended mix",
    ],
    "pop": ["pop", "rock", "indie", "punk", "metal", "alt", "alternative", "band", "guitar"],
}
VERSIONS = {
    "radio-edit": ["radio edit", "single edit"],
    "extended": ["extended", "club mix"],
    "acoustic": ["acoustic", "unplugged"],
    "live": ["live", "concert"],
    "clean": ["clean", "no explicit"],
    "remix": ["remix", "rework", "bootleg", "edit"],
    "original": ["original"],
}
DASHES = ["-", "–", "—"]
WITHOUT = ["kein", "keine", "keinen", "ohne"]
LOUDER = ["energetischer", "mehr energie", "eskalieren"]
SOFTER = ["keine harten", "weniger aggressiv"]
FEWER = ["weniger deutschrap", "weniger vocals", "weniger gesang"]


def spoken(x: Column) -> Column:
    """The lower-case words of a text with a single space before and after each; & is part of a word."""
    return F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}&]"), lambda w: w != ""), " "), F.lit(" "))


def says(words: Column, phrases: Sequence[str]) -> Column:
    """Whether spoken words hold one of the phrases."""
    return F.exists(F.array(*(F.lit(f" {p} ") for p in phrases)), lambda p: F.contains(words, p))


def first_said(words: Column, table: dict[str, list[str]]) -> Column:
    """The first entry of a table that the words hold a phrase of, or unknown."""
    return F.coalesce(*(F.when(says(words, phrases), F.lit(name)) for name, phrases in table.items()), F.lit("unknown"))


def genre_of(title: Column, uploader: Column | None = None) -> Column:
    """Family of genres by the words of a title, and of who put it up."""
    return first_said(spoken(title if uploader is None else F.concat_ws(" ", title, uploader)), GENRES)


def version_of(title: Column) -> Column:
    return first_said(spoken(title), VERSIONS)


def _bracketed(x: Column) -> Column:
    """The parts of a text: brackets with what is in them, and what stands between."""
    return F.regexp_extract_all(x, F.lit(r"[(\[{][^)\]}]*[)\]}]|[^(\[{]+|[(\[{]"), F.lit(0))


def _in_bracket(part: Column) -> Column:
    return F.left(part, F.lit(1)).isin("(", "[", "{") & (F.length(part) > 1)


def unbracketed(x: Column, phrases: Sequence[str] | None = None) -> Column:
    """Without the brackets that hold one of the phrases (any, if not given)."""
    lost = lambda p: _in_bracket(p) & (F.lit(True) if phrases is None else says(spoken(p), phrases))
    return F.array_join(F.filter(_bracketed(x), lambda p: ~lost(p)), "")


def _tokens(x: Column) -> Column:
    return F.filter(F.split(x, r"\s"), lambda w: w != "")


def _place(tokens: Column, wanted: Sequence[str], bare: bool = False) -> Column:
    """Place (from 1) of the first token that is wanted, 0 for none; bare: without regard to case and marks."""
    seen = F.transform(tokens, lambda w: F.trim(spoken(w))) if bare else tokens
    return F.array_position(F.transform(seen, lambda w: w.isin(*wanted)), True)


def without_guests(x: Column, words: Sequence[str] = GUESTS) -> Column:
    """Up to the word that names guests, with single spaces."""
    placed = once(_tokens(x), lambda t: F.struct(t.alias("tokens"), _place(t, words, bare=True).alias("at")))
    return once(placed, lambda p: F.array_join(F.when(p["at"] > 0, F.slice(p["tokens"], 1, F.greatest(p["at"] - 1, F.lit(0)).cast("int"))).otherwise(p["tokens"]), " "))


def clean_title(raw: Column, uploader: Column) -> Column:
    """struct(artist, title): junk in brackets, guests and quotes are cut; 'Artist - Title' splits at the first dash, else
    the uploader without the ending of a channel is the artist."""

    def split(tokens: Column) -> Column:
        # a dash with something on both sides
        middle = F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))
        return F.struct(tokens.alias("tokens"), F.when(F.size(tokens) > 2, _place(middle, DASHES)).otherwise(0).cast("int").alias("at"))

    def channel(names: Column) -> Column:
        last = F.lower(F.element_at(names, -1))
        marked = F.when(F.size(names) > 0, last.isin(*CHANNEL)).otherwise(False)
        left = F.when(marked, F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0)))).otherwise(names)
        return once(left, lambda n: F.array_join(F.when(marked & (last == "topic") & (F.size(n) > 0), F.slice(n, 1, F.size(n) - F.element_at(n, -1).isin(*DASHES).cast("int"))).otherwise(n), " "))

    def named(s: Column) -> Column:
        before, after = F.slice(s["tokens"], 1, s["at"]), F.slice(s["tokens"], s["at"] + 2, F.size(s["tokens"]))
        artist = F.when(s["at"] > 0, F.array_join(before, " ")).otherwise(F.nullif(once(_tokens(uploader), channel), F.lit("")))
        title = F.trim(F.translate(F.array_join(F.when(s["at"] > 0, after).otherwise(s["tokens"]), " "), "\"'", ""))
        return F.struct(artist.alias("artist"), once(title, lambda t: F.when(t == "", F.trim(raw)).otherwise(t)).alias("title"))

    return once(once(_tokens(without_guests(unbracketed(raw, JUNK))), split), named)


def title_variants(title: Column) -> Column:
    """Distinct shorter forms of a title to look it up by, the fullest first: as it is, without guests, then without
    brackets, or without what follows a dash."""

    def dashless(tokens: Column) -> Column:
        at = _place(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), DASHES[:1])
        return F.array_join(once(at, lambda a: F.when(a > 0, F.slice(tokens, 1, a.cast("int"))).otherwise(tokens)), " ")

    def forms(guestless: Column) -> Column:
        plain = F.array_join(_tokens(title), " ")
        return F.array(plain, guestless, F.array_join(_tokens(unbracketed(guestless)), " "), once(_tokens(guestless), dashless))

    return F.filter(F.array_distinct(once(without_guests(title, GUESTS_LOOSE), forms)), lambda x: x != "")


def _stamp_ms(stamp: Column) -> Column:
    """Milliseconds of [m:ss], [mm:ss.f] and the like; null if it is no time."""
    body = F.substring(stamp, 2, F.length(stamp) - 2)
    part = F.split(F.translate(body, ".", ":"), ":")
    digits = lambda x, low, high: (F.length(x) >= low) & (F.length(x) <= high)
    fraction = F.get(part, F.lit(2))
    timed = F.contains(F.split(body, r"\.")[0], F.lit(":")) & digits(part[0], 1, 2) & digits(F.get(part, F.lit(1)), 2, 2)
    timed &= (F.size(part) == 2) | ((F.size(part) == 3) & digits(fraction, 1, 3))
    seconds = part[0].try_cast("double") * 60 + F.get(part, F.lit(1)).try_cast("double") + F.concat(F.lit("0."), F.coalesce(fraction, F.lit("0"))).try_cast("double")
    return F.when(timed, half_up(seconds * 1000, 0).cast("long"))


def timed_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, time_ms, line) of texts whose lines have one or more time stamps in brackets; a line counts for each."""
    lines = df.select(key, F.explode(F.split(text, "\n")).alias("raw"))
    stamps = F.filter(F.regexp_extract_all("raw", F.lit(r"\[[0-9:.]+\]"), F.lit(0)), lambda s: _stamp_ms(s).isNotNull())
    found = lines.withColumn("stamps", stamps).where(F.size("stamps") > 0)
    line = F.trim(F.aggregate("stamps", F.col("raw"), lambda rest, s: F.replace(rest, s, F.lit(""))))
    return found.select(key, line.alias("line"), F.explode("stamps").alias("s")).select(key, _stamp_ms(F.col("s")).alias("time_ms"), "line")


def path_id(url: Column, host: str, kind: str, form: str) -> Column:
    """The id in a link to a thing of a kind on a host or its subdomains, at any depth of the path; null if it is none."""
    pattern = rf"^https?://(?:[a-z0-9-]+\.)*{host}/(?:[a-z-]+/)*{kind}/({form})(?:[/?#]|$)"
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://(?:www\.|m\.)?([^/:?#]+)", 1))


def _after(words: Column, marks: Sequence[str]) -> Column:
    """The word after the first of the marks; null if there is none."""
    at = _place(words, marks)
    return F.when(at > 0, F.get(words, at.cast("int")))


def intent(text: Column) -> Column:
    """struct(exclude, fewer, louder, softer, minutes, toward, following, confidence) of a request in German: a genre to
    leave out, what to have less of, whether to raise the energy or to be gentle, over how many minutes towards which
    genre, and the track to come next. Each thing said adds a tenth to the confidence."""

    def read(t: Column) -> Column:
        said, words = t["said"], t["words"]
        numbers = F.filter(F.transform(words, lambda w, k: F.struct(w.alias("w"), k.alias("k"))), lambda x: x["w"].rlike("^[0-9]+$"))
        framed = F.filter(numbers, lambda x: F.coalesce(F.get(words, x["k"] - 1).isin("in", "über") & F.startswith(F.get(words, x["k"] + 1), F.lit("min")), F.lit(False)))
        exclude = F.coalesce(_after(words, WITHOUT), F.when(says(said, ["auf keinen fall"]) & says(said, ["deutschrap"]), F.lit("deutschrap")))
        toward = F.coalesce(_after(words, ["richtung"]), F.when(says(said, ["danach gerne"]), _after(words, ["gerne"])))
        fewer = F.when(says(said, FEWER), F.when(says(said, ["deutschrap"]), "genre:deutschrap").otherwise("vocals"))
        play, end = _place(words, ["spiel"]), _place(words, ["als"])
        named = (play > 0) & (end > play + 1) & says(said, ["als nächstes"])
        following = F.when(named & (F.size(words) > 0), F.array_join(F.slice(words, (play + 1).cast("int"), F.greatest(end - play - 1, F.lit(0)).cast("int")), " "))
        return F.struct(
            exclude.alias("exclude"), fewer.alias("fewer"), says(said, LOUDER).alias("louder"), says(said, SOFTER).alias("softer"), F.get(framed, F.lit(0))["w"].try_cast("int").alias("minutes"),
            toward.alias("toward"), following.alias("following"),
        )

    def sure(i: Column) -> Column:
        hits = sum((i[n].isNotNull().cast("int") for n in ("exclude", "fewer", "minutes", "toward", "following")), F.lit(0)) + 2 * i["louder"].cast("int") + i["softer"].cast("int")
        own = [i[n].alias(n) for n in ("exclude", "fewer", "louder", "softer", "minutes", "toward", "following")]
        return F.struct(*own, half_up(clamp(0.45 + hits * 0.1)).alias("confidence"))

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}-]"), lambda w: w != "")
    return once(once(F.struct(spoken(text).alias("said"), words.alias("words")), read), sure)


def slug(x: Column) -> Column:
    """Letters and digits in lower case, joined by dashes."""
    return F.array_join(F.filter(F.split(F.lower(x), "[^a-z0-9]"), lambda w: w != ""), "-")
