"""Text functions of labels, titles and replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the key of a scene without letters or digits
OTHER_SCENE = "その他"
#: Families of special screens, by whole name and by phrase
FAMILY_NAMES = {"title": ("タイトル", "オープニング", "opening", "title"), "map": ("マップ", "地図", "map", "world map"), "menu": ("メニュー", "インベントリ", "menu", "inventory")}
FAMILY_PHRASES = {
    "title": ("タイトル画面", "オープニングタイトル", "title screen"),
    "map": ("世界地図", "ワールドマップ", "マップ画面", "map screen"),
    "menu": ("メニュー画面", "装備画面", "設定画面", "ステータス画面", "settings screen"),
}
#: Roles of a scene
ROLES = ("ordinary", "cinematic", "recurring_gameplay")
#: What follows a title, the first that is found counts; white space and digits of all scripts
TITLE_ENDS = (r"(?iU)\s+part\s*\d+.*$", r"(?iU)\s+#\d+.*$", r"(?iU)\s+パート\s*\d+.*$")


#: Characters whose folded form is not their lower case, by the rules of Unicode that Python's own strings follow
FOLDED = {c: c.casefold() for c in map(chr, range(0x110000)) if c.casefold() != c.lower()}
FOLDING = "[" + "".join(FOLDED) + "\u03a3]"  # and capital sigma, whose lower case depends on its place


def casefold(text: Column) -> Column:
    """Text for comparisons without regard to case: sharp s is ss, ligatures are their letters."""
    table = F.create_map(*(F.lit(x) for pair in FOLDED.items() for x in pair))
    each = F.transform(F.split(text, "(?<=.)(?=.)"), lambda c: F.coalesce(F.try_element_at(table, c), F.lower(c)))
    return F.when(text.rlike(FOLDING), F.array_join(each, "")).otherwise(F.lower(text))


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_scene(scene: Column) -> Column:
    """Letters and digits without regard to case, 48 characters at most, or a fixed name if none is left."""
    kept = F.substring(F.regexp_replace(casefold(scene), r"[^\p{L}\p{N}]", ""), 1, 48)
    return F.when(F.coalesce(kept, F.lit("")) == "", OTHER_SCENE).otherwise(kept)


def screen_family(scene: Column) -> Column:
    """The family of a special screen by its whole name, else by a phrase in it, else content."""
    name = strip(casefold(scene))
    named = [(family, name.isin(*names)) for family, names in FAMILY_NAMES.items()]
    phrased = [(family, reduce(Column.__or__, (name.contains(p) for p in phrases))) for family, phrases in FAMILY_PHRASES.items()]
    out = F
    for family, found in named + phrased:
        out = out.when(found, family)
    return out.otherwise("content")


def role(value: Column) -> Column:
    """A known role, else ordinary."""
    return F.when(strip(value).isin(*ROLES), strip(value)).otherwise("ordinary")


def infer_title(stem: Column) -> Column:
    """The stem without the first suffix of the kinds "Part n", "#n", "パート n" that it has; never empty."""
    title = strip(stem)
    cuts = F.array(*(strip(F.regexp_replace(title, pattern, "")) for pattern in TITLE_ENDS))
    cut = F.get(F.filter(cuts, lambda x: x != title), F.lit(0))
    return F.when(cut != "", cut).otherwise(title)


def frame_interval(rate: Column) -> Column:
    """Seconds a frame from "a/b" or a number; 0 if that is no positive rate."""
    parts = F.split(rate, "/", 2)
    a, b = F.get(parts, F.lit(0)).try_cast("double"), F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("double")).otherwise(1.0)
    fps = F.try_divide(a, b)
    return F.when((fps > 0) & (fps < float("inf")), 1.0 / fps).otherwise(0.0)


def duration_label(seconds: Column) -> Column:
    """Minutes, rounded half to even, with hours if there are any."""
    minutes = F.bround(seconds / 60.0, 0).cast("long")
    hours = F.floor(minutes / 60)
    return F.when(hours > 0, F.format_string("約%d時間%d分", hours, minutes % 60)).otherwise(F.format_string("約%d分", minutes))


def timestamp_label(seconds: Column) -> Column:
    t = F.greatest(F.lit(0).cast("long"), F.bround(seconds, 0).cast("long"))
    h, m, s = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def source_label(index: Column, name: Column) -> Column:
    return F.format_string("v%02d %s", index, name)


def host_url(host: Column, port: int = 11434) -> Column:
    """Scheme and port added where they are missing."""
    full = F.when(host.contains("://"), host).otherwise(F.concat(F.lit("http://"), host))
    full = F.rtrim(full, F.lit("/"))
    return F.when(F.regexp_extract(full, r"://[^/]*?(:\d+)", 1) != "", full).otherwise(F.regexp_replace(full, r"^(\w+://[^/]*)", f"$1:{port}"))


def salvaged_json(reply: Column) -> Column:
    """The widest {...} in a reply."""
    return F.regexp_extract(reply, r"(?s)\{.*\}", 0)
