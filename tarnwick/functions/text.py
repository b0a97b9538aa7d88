"""Column functions on names, labels and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(label: Column) -> Column:
    """Words of a label, underscores read as blanks, empty words dropped."""
    return F.filter(F.split(F.trim(F.translate(label, "_", " ")), r"\s+"), lambda w: F.length(w) > 0)


def last_words(label: Column, count: int) -> Column:
    """The last ``count`` words joined by blanks, all of them if there are fewer."""
    parts = words(label)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - count + 1, F.lit(1)), count), " ")


def stem(path: Column) -> Column:
    """File name without directories and without its last ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Lower-case ending with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def parent(path: Column) -> Column:
    """Name of the directory that holds the file, empty if the path has none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))


def clean_filename(name: Column) -> Column:
    """Blanks and underscores at the end dropped, the first letter upper case, the rest kept."""
    bare = F.regexp_replace(name, "[_ ]+$", "")
    return F.concat(F.upper(F.substr(bare, F.lit(1), F.lit(1))), F.substr(bare, F.lit(2)))


def short_label(label: Column) -> Column:
    """``G. epithet`` for two words or more, a repeated genus counted once; other labels stay."""
    parts = words(label)
    size = F.size(parts)
    head = F.concat(F.substr(F.get(parts, F.lit(0)), F.lit(1), F.lit(1)), F.lit(". "))
    rest = lambda first: F.array_join(F.slice(parts, first, F.greatest(size - first + 1, F.lit(0))), " ")
    repeated = (size >= 3) & (F.get(parts, F.lit(0)) == F.get(parts, F.lit(1)))
    return F.when(repeated, F.concat(head, rest(F.lit(3)))).when(size >= 2, F.concat(head, rest(F.lit(2)))).otherwise(label)


def newick_label(label: Column) -> Column:
    """A label safe inside a tree text: blanks become underscores, full stops go."""
    return F.translate(F.translate(label, " ", "_"), ".", "")


def feature_name(group: str, position: Column) -> Column:
    """Name of a feature of one of the eight groups by its zero-based place: bins by their bounds, filters by angle and frequency."""
    two = lambda c: F.format_string("%02d", c)
    of = lambda *names: F.get(F.array(*map(F.lit, names)), position)
    if group in ("hue_hist", "sat_hist", "val_hist"):
        width = 10 if group == "hue_hist" else 32
        return F.format_string(f"{group[:3]}_bin_%03d_%03d", position * width, (position + 1) * width)
    if group == "dom_colours":
        channel = F.get(F.array(F.lit("hue"), F.lit("sat"), F.lit("val")), position % 3)
        return F.when(position < 15, F.format_string("domcol_%d_%s", F.floor(position / 3), channel)).otherwise(F.format_string("domcol_%d_freq", position - 15))
    if group == "dorsal_ventral":
        return of(*[f"{region}_{channel}_mean" for region in ("dorsal", "ventral", "dv_diff") for channel in ("hue", "sat", "val")])
    if group == "gabor":
        return of(*[f"gabor_t{angle:03d}_f{frequency}_{stat}" for angle in (0, 45, 90, 135) for frequency in ("0p1", "0p2", "0p4") for stat in ("mean", "std")])
    return F.concat(F.lit("lbp_bin_"), two(position)) if group == "lbp" else of("hue_entropy", "lbp_entropy")


def replaced(label: Column, short: dict[str, str]) -> Column:
    """A label with each key of ``short`` and the underscore or blank behind it replaced, one key after another."""
    for name, initial in short.items():
        for mark in ("_", " "):
            label = F.replace(label, F.lit(name + mark), F.lit(initial))
    return label


def looked_up(key: Column, known: dict[str, str], default: str) -> Column:
    """The value of ``known`` for a key, the default for others and for null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), key), F.lit(default))


def percent(value: Column) -> Column:
    """``12.3%`` of a fraction."""
    return F.format_string("%.1f%%", value * 100)
