"""File names: extensions, languages, release details and scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from intervane.functions.rounding import bind

# Extensions.
SUBTITLES = ("ass", "ssa", "srt")
ARCHIVES, CLOSED_ARCHIVES = ("zip",), ("rar", "7z")
# Machine transcription marks, small letters; the second counts in brackets only.
MACHINE, MACHINE_IN_BRACKETS = "whisperai", "whisper"
# Language tokens of file names.
JAPANESE = ("jpn", "jap", "jp", "ja", "japanese", "日本語", "日文", "日语")
CHINESE = ("chs", "cht", "chi", "zho", "zh", "sc", "tc", "gb", "big5", "hans", "hant", "简体", "繁體", "繁体", "中文", "简中", "繁中")
BILINGUAL = ("中日", "日中", "简日", "繁日", "双语", "雙語", "bilingual")
# Source families.
FAMILIES = {"BD": ("bd", "bdrip", "bluray", "bdmv", "bdremux"), "DVD": ("dvd", "dvdrip", "dvd5", "dvd9", "r2j", "r2dvd"), "WEB": ("web", "webdl", "webrip", "www"), "TV": ("tv", "hdtv", "tvrip", "sdtv", "dtv", "ova", "ona", "oav")}
# Bracketed words that are no release group.
NO_GROUPS = ("sdh", "cc", "forced", "full", "dialogue", "signs", "songs", "hi", "sub", "subs")
# An episode number with a fraction, after SxxE, E or EP, or a dash.
FRACTIONAL = r"(?:[Ss]\d{1,2}\s?[Ee]|(?<![A-Za-z])[Ee][Pp]?|(?<=\s[-–]\s))(\d{1,3})\.(\d)(?![\d\w])"
# Points of a name score.
POINTS = {"group": 45, "source": 25, "resolution": 10, "video": 5, "audio": 5, "episode": 10, "checksum": 100}

_VIDEO = r"(?i)(?:^|[\s\[\]()._-])(x26[45]|h\.?26[45]|hevc|avc|av1|xvid|10.?bit|hi10p?)(?=$|[\s\[\]()._-])"
_AUDIO = r"(?i)(?:^|[\s\[\]()._-])(flac|aac|ac3|e-?ac-?3|dts|opus|mp3|truehd)(?=$|[\s\[\]()._-]|\d)"
_SOURCE = r"(?i)(?:^|[\s\[\]()._-])(bdrip|blu-?ray|bdmv|bdremux|bd|dvdrip|dvd[59]?|r2j|r2dvd|web-?dl|webrip|web|hdtv|tvrip|sdtv|dtv|tv|ova|ona|oav)(?=$|[\s\[\]()._-])"
_RESOLUTION = r"(?i)(\d{3,4}\s?[x×]\s?\d{3,4}|\d{3,4}[pi])(?![A-Za-z0-9])"


def extension(name: Column) -> Column:
    """Lower-case letters after the last dot, empty if there are none."""
    return F.lower(F.regexp_extract(name, r"\.([^./\\]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def machine_made(name: Column) -> Column:
    low = F.lower(name)
    made = low.contains(MACHINE)
    for opening in "[(":
        for closing in "])":
            made = made | low.contains(opening + MACHINE_IN_BRACKETS + closing)
    return made


def language(name: Column) -> Column:
    """Multilingual, JapaneseOnly, NoJapanese or Unknown: a bilingual mark anywhere, else whole tokens."""
    low = F.lower(name)
    tokens = F.split(low, r"[.\[\]()_\- ,&+{}@]+")
    any_of = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    ja, zh = any_of(JAPANESE), any_of(CHINESE)
    both = low.contains(BILINGUAL[0])
    for w in BILINGUAL[1:]:
        both = both | low.contains(w)
    return F.when(both | (ja & zh), "Multilingual").when(ja, "JapaneseOnly").when(zh, "NoJapanese").otherwise("Unknown")


def language_rank(lang: Column) -> Column:
    return F.when(lang.isin("JapaneseOnly", "Unknown"), 0).when(lang == "Multilingual", 1).otherwise(2)


def resolution(text: Column) -> Column:
    """1920x1080 -> 1080p; others lower-case; NULL for none."""
    t = F.lower(F.trim(text))
    height = F.regexp_extract(t, r"^[^x×]+[x×]\s*(\d+)\s*$", 1).try_cast("int")
    return F.when(F.length(t) > 0, F.when(height.isNotNull(), F.concat(height.cast("string"), F.lit("p"))).otherwise(t))


def source_family(text: Column) -> Column:
    """BD, DVD, WEB or TV, else the text in capitals; NULL for none."""
    t = F.lower(F.regexp_replace(text, "[- ]", ""))
    family = F.lit(None).cast("string")
    for name, tokens in reversed(FAMILIES.items()):
        family = F.when(t.isin(*tokens), name).otherwise(family)
    return F.when(F.length(F.trim(text)) > 0, F.coalesce(family, F.upper(text)))


def token(text: Column) -> Column:
    """Letters and digits alone, lower-case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def _some(x: Column) -> Column:
    return F.when(F.length(F.trim(x)) > 0, x)


def _first(x: Column, pattern: str) -> Column:
    """Group 1 of the first match, NULL without one; the pattern runs once."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.lit(1))


def release(name: Column) -> Column:
    """struct<group, episode, resolution, source, checksum, video, audio>: an approximation of a release-name grammar by patterns.

    The group is a leading bracket, else what follows the last dash; the episode follows SxxE, E/EP, #, or a spaced dash, or is
    a bracketed number of at most three digits.
    """
    base = F.regexp_replace(name, r"\.[A-Za-z0-9]{2,4}$", "")
    return bind(base, lambda b: _release(name, b))


def _release(name: Column, base: Column) -> Column:
    group = F.coalesce(_first(base, r"^\s*\[([^\]]+)\]"), _first(base, r"-(?!\d+$)([A-Za-z0-9]+)$"))
    checksum = F.upper(_first(name, r"[\[(]([0-9A-Fa-f]{8})[\])]"))
    group = bind(group, lambda g: F.when(~F.lower(F.trim(g)).isin(*NO_GROUPS) & ~g.rlike(r"^[0-9A-Fa-f]{8}$"), g))
    tries = [r"[Ss]\d{1,2}\s?[Ee](\d{1,4})(?![\d.]*\.\d(?!\d))", r"(?<![A-Za-z])[Ee][Pp]?\.?\s?(\d{1,4})(?![\d])", r"\s[-–]\s#?(\d{1,4})(?:v\d)?(?=$|[\s\[(._])", r"#(\d{1,4})(?!\d)", r"\[(\d{1,3})(?:v\d)?\]"]
    fraction = base.rlike(FRACTIONAL)
    episode = F.coalesce(*[_first(base, p) for p in tries]).try_cast("int")
    pick = lambda p: _first(base, p)
    return F.struct(group.alias("group"), F.when(~fraction, episode).alias("episode"), pick(_RESOLUTION).alias("resolution"), pick(_SOURCE).alias("source"), checksum.alias("checksum"), pick(_VIDEO).alias("video"), pick(_AUDIO).alias("audio"))


def fractional_episode(name: Column) -> Column:
    """struct<whole int, text string> of a fractional episode number, NULL if there is none."""
    whole = F.regexp_extract(name, FRACTIONAL, 1)
    return F.when(name.rlike(FRACTIONAL), F.struct(whole.cast("int").alias("whole"), F.concat(whole.cast("int").cast("string"), F.lit("."), F.regexp_extract(name, FRACTIONAL, 2)).alias("text")))


def compared(of: Column) -> Column:
    """What match() compares of a release struct: tokens of its fields and of its source family, NULL for blank ones, and the episode."""
    some = lambda x: F.when(F.length(F.trim(x)) > 0, token(x))
    fields = {"group": of["group"], "source": source_family(of["source"]), "resolution": resolution(of["resolution"]), "video": of["video"], "audio": of["audio"], "checksum": of["checksum"]}
    return F.struct(of["episode"].alias("episode"), *[some(c).alias(n) for n, c in fields.items()])


def match(video: Column, subtitle: Column, expected: Column, alternate: Column | None = None) -> Column:
    """struct<score int, exact, episode_mismatch, source_mismatch, source_match> of two release structs.

    An alternate number keeps a file from being ruled out but earns no points.
    """
    both = F.struct(compared(video).alias("v"), compared(subtitle).alias("s"))
    return bind(both, lambda p: agree(p["v"], p["s"], expected, alternate))


def agree(video: Column, subtitle: Column, expected: Column, alternate: Column | None = None) -> Column:
    """match() of two structs of compared()."""
    alternate = alternate if alternate is not None else F.lit(None).cast("int")
    same = lambda n: F.coalesce(video[n] == subtitle[n], F.lit(False))
    exact, ep = same("checksum"), subtitle["episode"]
    wrong = ep.isNotNull() & (expected.isNotNull() | alternate.isNotNull()) & ~F.coalesce(ep == expected, F.lit(False)) & ~F.coalesce(ep == alternate, F.lit(False))
    known = video["source"].isNotNull() & subtitle["source"].isNotNull()
    add = lambda cond, what: F.when(cond, POINTS[what]).otherwise(0)
    score = add(F.coalesce(ep == expected, F.lit(False)), "episode")
    for what in ("group", "source", "resolution", "video", "audio"):
        score = score + add(same(what), what)
    out = lambda s, e, m, x, y: F.struct(s.alias("score"), e.alias("exact"), m.alias("episode_mismatch"), x.alias("source_mismatch"), y.alias("source_match"))
    no, yes = F.lit(False), F.lit(True)
    return F.when(exact, out(F.lit(100), yes, no, no, yes)).when(wrong, out(F.lit(0), no, yes, no, no)).otherwise(out(F.least(score, F.lit(100)), no, no, known & ~same("source"), same("source")))


def sidecar_name(video_path: Column, tag: Column, ext: Column) -> Column:
    return F.concat(stem(video_path), F.lit("."), F.lower(tag), F.lit("."), F.lower(F.regexp_replace(ext, r"^\.+", "")))


def looks_like_ours(path: Column, base: Column, tag: Column) -> Column:
    name = F.lower(stem(path))
    return extension(path).isin(*SUBTITLES) & name.startswith(F.concat(F.lower(base), F.lit("."))) & name.endswith(F.concat(F.lit("."), F.lower(tag)))


def lenient_int(text: Column) -> Column:
    """A number, a string of one, or the first of a comma list; else NULL."""
    return F.trim(F.split_part(text, F.lit(","), F.lit(1))).try_cast("int")


def opaque_id(record: Column) -> Column:
    """Base64url of the record's JSON, without padding."""
    return F.rtrim(F.translate(F.base64(F.to_json(record).cast("binary")), "+/\r\n", "-_"), F.lit("="))


def from_opaque_id(text: Column, schema: str) -> Column:
    padded = F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), (4 - F.length(text) % 4) % 4))
    return F.from_json(F.unbase64(padded).cast("string"), schema)


def name_query(series: Column, season: Column, title: Column) -> Column:
    """What to search for by name: series and title for specials, series and season number beyond the first, else the series."""
    blank = lambda x: x.isNull() | (F.length(F.trim(x)) == 0)
    special = F.when(blank(title), F.coalesce(series, F.lit(""))).otherwise(F.concat(F.coalesce(series, F.lit("")), F.lit(" "), title))
    plain = F.when(~blank(series), F.when(season > 1, F.concat(series, F.lit(" "), season.cast("string"))).otherwise(series))
    return _some(F.when(season == 0, special).otherwise(plain))


def fingerprint(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
