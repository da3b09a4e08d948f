"""Array arithmetic: distances, squashing functions, simple classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle, 0 if one vector is."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def clamp(values: Column) -> Column:
    return F.transform(values, lambda x: F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / _sum(powers))


def logistic_score(values: Column, weights: list[float], bias: float) -> Column:
    return sigmoid(dot(values, F.array(*map(F.lit, weights))) + bias)


def log_loss(probability: Column, label: Column) -> Column:
    p = F.least(F.greatest(probability, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -(label * F.log(p) + (1 - label) * F.log(1 - p))


#: File classes.
FILE_TYPES = ("Unknown", "Executable", "Document", "Image", "Audio", "Video", "Archive", "Database", "Log", "Configuration", "Temporary", "System", "Malware")
#: Descriptions of the file types, in the same order.
TYPE_DESCRIPTIONS = (
    "Unknown file type", "Executable program or script", "Text document or office document", "Image file (JPEG, PNG, etc.)", "Audio file (MP3, WAV, etc.)", "Video file (MP4, AVI, etc.)",
    "Compressed archive (ZIP, RAR, etc.)", "Database file", "Log file", "Configuration file", "Temporary file", "System file", "Malicious software",
)
#: Class number by extension, for training labels.
LABELS = {"exe": 1, "dll": 1, "txt": 2, "doc": 2, "pdf": 2, "jpg": 3, "png": 3, "gif": 3, "mp3": 4, "wav": 4, "mp4": 5, "avi": 5, "zip": 6, "rar": 6}


def type_name(number: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in enumerate(FILE_TYPES) for x in pair))[number], F.lit("Unknown"))


def type_description(number: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in enumerate(TYPE_DESCRIPTIONS) for x in pair))[number], F.lit("Unknown file type"))


def label_of(suffix: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[suffix], F.lit(0))


def _result(kind: str, confidence: Column | float) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence") if isinstance(confidence, float) else confidence.alias("confidence"))


def classify(values: Column, weights: list[float], bias: float) -> Column:
    """Struct (type, confidence) by logistic score, then by the first feature."""
    p = logistic_score(values, weights, bias)
    return F.when(F.size(values) == 0, _result("Unknown", 0.0)).when(p > 0.9, _result("Malware", p)).when(p > 0.7, _result("Executable", p)).when(values[0] > 0.5, _result("Document", 0.7)).otherwise(_result("Unknown", 0.5))


def classify_by_mean(values: Column) -> Column:
    mean = _sum(values) / F.size(values)
    return F.when(F.size(values) == 0, _result("Unknown", 0.0)).when(mean > 0.7, _result("Malware", 0.9)).when(mean > 0.3, _result("Executable", 0.7)).otherwise(_result("Unknown", 0.5))


def classify_by_margin(values: Column, weights: list[float], bias: float) -> Column:
    """Sign of a linear margin; the confidence grows with it towards 1."""
    s = dot(values, F.array(*map(F.lit, weights))) + bias
    sure = F.abs(s) / (F.abs(s) + 1)
    return F.when(s > 0, _result("Malware", sure)).otherwise(_result("Unknown", sure))
