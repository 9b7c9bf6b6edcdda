"""Labels, speakers and codes read out of file names and language tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parley.functions.text import blank_to_null, strip

# Emotion words in file names, in the order they are tried.
EMOTION_WORDS = ("neutral", "calm", "happy", "sad", "angry", "fearful", "disgust", "surprised")

# Emotion by its two-digit code in the third part of a coded file name.
EMOTION_CODES = {
    1: "neutral", 2: "calm", 3: "happy", 4: "sad", 5: "angry", 6: "fearful", 7: "surprised", 8: "disgust",
}

# The data set whose file names carry codes.
CODED_DATASET = "RAVDESS"
RECORDING_PREFIX = "EXPO_"

# Folders that are never a speaker name.
STAGE_FOLDERS = ("staged", "processed", "extracted", "wav")
PLAIN_FOLDERS = (*STAGE_FOLDERS, "data", "raw")

# How a speaker number is written.
SPEAKER_FOLDER = r"(?:actor_?|speaker_?|subject_?)_?(\d{2,3})$"
SPEAKER_IN_NAME = r"(?:actor_?|speaker_?|subject_?)_?(\d{2,3})"
TRAILING_NUMBER = r"(\d{2,3})$"
CODED_NAME = r"^\d{2}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2}$"

# Three-letter language code, name, two-letter code.
LANGUAGES = (
    ("eng", "English", "en"), ("spa", "Spanish", "es"), ("fra", "French", "fr"), ("deu", "German", "de"),
    ("ita", "Italian", "it"), ("por", "Portuguese", "pt"), ("hin", "Hindi", "hi"), ("mar", "Marathi", "mr"),
    ("tel", "Telugu", "te"), ("tam", "Tamil", "ta"), ("ben", "Bengali", "bn"), ("urd", "Urdu", "ur"),
    ("ara", "Arabic", "ar"), ("zho", "Chinese", "zh"), ("jpn", "Japanese", "ja"), ("kor", "Korean", "ko"),
    ("rus", "Russian", "ru"), ("nld", "Dutch", "nl"), ("pol", "Polish", "pl"), ("tur", "Turkish", "tr"),
    ("vie", "Vietnamese", "vi"),
)

# Language labels of the user interface.
LANGUAGE_LABELS = {
    "auto-detect": "auto", "english": "en", "spanish": "es", "mandarin": "zh", "french": "fr",
    "arabic": "ar", "hindi": "hi", "portuguese": "pt", "russian": "ru", "german": "de",
}

# Roles given to live speakers in turn.
SPEAKER_ROLES = ("Judge", "Witness", "Attorney", "Defendant")

SPLITS = ("dev", "test", "holdout")


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a small fixed mapping, null for an unknown key."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension (a leading dot is no extension)."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parents_up(path: Column) -> Column:
    """Folders of a path, nearest first."""
    parts = path_parts(path)
    return F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))


def _group(c: Column, pattern: str) -> Column:
    return blank_to_null(F.regexp_extract(c, pattern, 1))


def infer_speaker(path: Column) -> Column:
    """Speaker id: nearest speaker folder, digits in the name, nearest real folder, or the name itself."""
    folders = F.filter(parents_up(path), lambda p: ~p.isin(*PLAIN_FOLDERS))
    numbers = F.transform(folders, lambda p: F.regexp_extract(F.lower(p), SPEAKER_FOLDER, 1))
    name = stem(path)
    real = F.filter(parents_up(path), lambda p: ~p.isin(*STAGE_FOLDERS))
    return F.coalesce(
        F.try_element_at(F.filter(numbers, lambda n: n != ""), F.lit(1)),
        _group(name, TRAILING_NUMBER),
        _group(F.lower(name), SPEAKER_IN_NAME),
        F.try_element_at(real, F.lit(1)),
        F.substring(name, 1, 32),
    )


def infer_label(path: Column) -> Column:
    """Emotion: code in the third dash part of a coded name, else the first emotion word found."""
    name, parts = stem(path), F.transform(path_parts(path), F.lower)
    coded = F.array_contains(parts, CODED_DATASET.lower()) | name.rlike(CODED_NAME)
    code = F.try_element_at(F.split(name, "-"), F.lit(3)).try_cast("int")
    found = [
        F.when(F.contains(F.lower(name), F.lit(w)) | F.array_contains(parts, w), F.lit(w)) for w in EMOTION_WORDS
    ]
    return F.coalesce(F.when(coded, lookup(EMOTION_CODES, code)), *found, F.lit("unknown"))


def statement_code(name: Column) -> Column:
    """Fifth dash part of a coded file name."""
    fits = name.startswith(f"{CODED_DATASET}_") & name.endswith(".wav")
    base = F.replace(F.replace(name, F.lit(f"{CODED_DATASET}_"), F.lit("")), F.lit(".wav"), F.lit(""))
    return F.when(fits, F.try_element_at(F.split(base, "-"), F.lit(5)))


def timestamp_in_name(name: Column) -> Column:
    """What stands between the recording prefix and the extension, else an empty text."""
    fits = name.startswith(RECORDING_PREFIX) & F.lower(name).endswith(".wav")
    n = len(RECORDING_PREFIX)
    return F.when(fits, F.substring(name, F.lit(n + 1), F.length(name) - (n + 4))).otherwise(F.lit(""))


def split_from_path(path: Column) -> Column:
    """dev, test or holdout when it is a whole path part, else unknown."""
    parts = F.split(path, "/")
    return F.coalesce(*[F.when(F.array_contains(parts, s), F.lit(s)) for s in SPLITS], F.lit("unknown"))


def language_name(code: Column) -> Column:
    """``Name (xx)`` for a two- or three-letter code."""
    c = F.lower(strip(code))
    by_two = lookup({two: f"{name} ({two})" for _, name, two in LANGUAGES}, c)
    by_three = lookup({three: f"{name} ({two})" for three, name, two in LANGUAGES}, F.substring(c, 1, 3))
    unknown = F.concat(F.lit("Unknown ("), F.substring(c, 1, 3), F.lit(")"))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit("Unknown"))
        .when(F.length(c) == 2, F.coalesce(by_two, unknown))
        .otherwise(F.coalesce(by_three, unknown))
    )


def language_short(code: Column, override: Column | None = None) -> Column:
    """Two-letter tag, English when unknown; an override other than ``auto`` wins."""
    c = F.lower(strip(code))
    by_three = lookup({three: two for three, _, two in LANGUAGES}, F.substring(c, 1, 3))
    short = (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit("en"))
        .when(c.rlike(r"^\p{L}{2}$"), c)
        .otherwise(F.coalesce(by_three, F.lit("en")))
    )
    if override is None:
        return short
    o = F.lower(strip(F.coalesce(override, F.lit(""))))
    return F.when((o != "") & (o != "auto"), o).otherwise(short)


def language_code(label: Column) -> Column:
    """Code of a language label of the user interface; other labels pass in lower case."""
    c = F.lower(strip(label))
    return F.coalesce(lookup(LANGUAGE_LABELS, c), c)


def label_or_unknown(emotion: Column, label: Column | None = None) -> Column:
    """Emotion, else label, else ``unknown``; blank counts as missing."""
    cands = [blank_to_null(emotion)] + ([] if label is None else [blank_to_null(label)])
    return F.coalesce(*cands, F.lit("unknown"))


def duration_bucket(seconds: Column) -> Column:
    """short (< 2 s), medium (to 5 s) or long; missing counts as 0."""
    d = F.coalesce(seconds, F.lit(0.0))
    return F.when(d < 2.0, "short").when(d <= 5.0, "medium").otherwise("long")


DURATION_BUCKETS = ("short", "medium", "long")


def role_in_turn(n: Column) -> Column:
    """Role of the n-th utterance (from 1)."""
    return F.element_at(F.array(*[F.lit(r) for r in SPEAKER_ROLES]), ((n - 1) % len(SPEAKER_ROLES) + 1).cast("int"))
