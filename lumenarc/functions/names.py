"""Column functions over paths and file names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of special and edited copies, folders with a meaning of their own, beginnings of untitled
# albums, and the extension of each type by content.
EDITED_SUFFIXES = ["-effects", "-motion", "-animation", "-smile", "-collage", "-mix", "-edited", "-edytowane", "-bearbeitet", "-bewerkt", "-編集済み", "-编辑", "-modificato", "-modifié", "-ha editado", "-editado", "-editat"]
SPECIAL_FOLDERS = ["locked folder", "archive", "trash", "archivo", "papelera", "arquivo", "lixeira", "archivio", "cestino", "corbeille", "archiv", "papierkorb", "archief", "prullenbak", "архив", "корзина", "archiwum", "kosz", "档案", "回收站", "アーカイブ", "ゴミ箱", "arxiu", "paperera"]
UNTITLED_PREFIXES = ["untitled", "unknown", "desconocido", "sin título", "desconhecido", "sem título", "sconosciuto", "senza titolo", "inconnu", "sans titre", "Unbenannt", "ohne titel", "onbekend", "zonder titel", "неизвестный", "без названия", "nieznany", "bez tytułu", "未知", "无标题", "不明", "無題", "desconegut", "sense títol"]
MEDIA_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp", "heic", "heif", "webp", "avif", "svg", "tif", "tiff", "mp4", "m4v", "mov", "avi", "mkv", "webm", "3gp", "flv", "mts", "mp", "mv", "dng", "cr2"]
VIDEO_EXTENSIONS = ["mp4", "m4v", "mov", "avi", "mkv", "webm", "3gp", "flv", "mts", "mp", "mv"]
PREFERRED_EXTENSION = {"image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/heic": "heic", "image/avif": "avif", "image/bmp": "bmp", "image/svg+xml": "svg", "video/mp4": "mp4", "video/avi": "avi", "video/mov": "mov", "video/quicktime": "mov", "video/x-msvideo": "avi", "video/webm": "webm", "video/x-matroska": "mkv", "video/3gpp": "3gp", "video/x-flv": "flv"}
RESTORABLE = ["jpg", "png", "gif", "mp4", "mov", "avi", "mp"]
SIDECAR_SUFFIX = ".supplemental-metadata"
NAME_LIMIT = 51
SIZE_LIMIT = 64 << 20
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"{port}{n}" for port in ("COM", "LPT") for n in range(1, 10))]


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"^(.*)/[^/]*$", 1)


def extension(name: Column) -> Column:
    """Lower case, without the dot; a name that starts with its only dot has none."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def is_year_folder(folder: Column) -> Column:
    return folder.rlike(r"^(Photos from|Fotos del|Fotos von) \d{4}$")


def is_canonical(folder: Column) -> Column:
    """A folder named by a year, or one that says it holds the photos of a year."""
    return folder.rlike(r"^(19|20)\d{2}$") | folder.rlike(r"(?i)photos\s+from\s+(19|20)\d{2}")


def is_canonical_target(directory: Column) -> Column:
    """A place below ALL_PHOTOS, or below a year, ``year/month`` or ``year-month`` folder."""
    return directory.rlike(r"(^|/)ALL_PHOTOS(/|$)|(^|/)(19|20)\d{2}(-(0[1-9]|1[0-2]))?(/|$)")


def in_year_folder(path: Column) -> Column:
    """Whether any segment is a bare year or the photos of a year, in any case."""
    year = r"(?i)^(\d{4}|(photos\s+from|fotos\s+del|fotos\s+von)\s+\d{4})$"
    return F.exists(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda part: F.trim(part).rlike(year))


def is_edited(name: Column) -> Column:
    """Also where the name writes an accent as a character of its own, as some file systems do."""
    plain = F.lower(stem(name))
    apart = [unicodedata.normalize("NFD", s) for s in EDITED_SUFFIXES]
    return F.exists(F.array(*map(F.lit, dict.fromkeys(EDITED_SUFFIXES + apart))), lambda suffix: plain.endswith(suffix))


def without_extra(name: Column) -> Column:
    """The name before an edit: by the complete ending; else by a partial one; else a film's still; else by the edge case."""
    film = is_edited(name) & extension(name).isin("mp4", "mov", "avi")
    still = F.concat(F.regexp_replace(stem(name), ends_with_edit(99), ""), F.lit(".jpg"))
    tried = [without_edit(name), without_partial_edit(name), F.when(film, still).otherwise(name), without_edge_edit(name)]
    return F.coalesce(*(F.when(t != name, t) for t in tried), name)


def too_large(size: Column, enforced: Column, limit: int = SIZE_LIMIT) -> Column:
    """Beyond the limit, if the limit is enforced."""
    return enforced & (size > limit)


def zip_entry_name(path: Column) -> Column:
    """Segments without characters and endings that some systems refuse; a last one that is a device's name gets ``_file``."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    clean = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, r'[<>:"|?*\x00-\x1f]', "_"), r"[. ]+$", ""))

    def last(x: Column) -> Column:
        return F.when(F.upper(stem(x)).isin(RESERVED_NAMES), F.concat(stem(x), F.lit("_file"), F.regexp_extract(x, r"^.+(\.[^.]*)$", 1))).otherwise(x)

    named = F.transform(clean, lambda x, i: F.when(i == F.size(clean) - 1, last(x)).otherwise(x))
    return F.array_join(F.transform(named, lambda x: F.when(x == "", "_").otherwise(x)), "/")


def special_folder(path: Column) -> Column:
    """The capitalised name of the first segment that is a special folder; null without one."""
    found = F.filter(F.split(F.lower(path), "/"), lambda part: part.isin(SPECIAL_FOLDERS))
    first = F.get(found, 0)
    return F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1000))


def is_untitled(album: Column) -> Column:
    return F.exists(F.array(*(F.lit(p.lower()) for p in UNTITLED_PREFIXES)), lambda prefix: F.lower(album).startswith(prefix))


def short_name(name: Column) -> Column:
    """Cut so that the name and ``.json`` stay within the limit."""
    return F.when(F.length(name) + 5 > NAME_LIMIT, F.left(name, F.lit(NAME_LIMIT - 5))).otherwise(name)


def bracket_swap(name: Column) -> Column:
    """``image(11).jpg`` to ``image.jpg(11)``, the last bracket."""
    return F.regexp_replace(name, r"^(.*)(\(\d+\))(\.[^.]*)$", "$1$3$2")


def clean_segments(path: Column) -> Column:
    """Control characters out, trailing dots and spaces of each segment too; an empty one becomes ``_``."""
    parts = F.transform(F.split(path, "/"), lambda p: F.regexp_replace(F.regexp_replace(p, r"[\x00-\x1f]", ""), r"[. ]+$", ""))
    return F.array_join(F.transform(parts, lambda p: F.when(p == "", "_").otherwise(p)), "/")


def safe_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"\s+", " "))


def pixel_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.m[pv]$", ".mp4")


def ends_with_edit(least: int) -> str:
    """A pattern for the first ``least`` or more characters of an edited ending, with or without a number in brackets."""
    begun = {s[:n] for s in EDITED_SUFFIXES for n in range(min(least, len(s)), len(s) + 1)}
    return "(?iu)(" + "|".join(sorted(begun, key=lambda x: (-len(x), x))) + r")(\(\d+\))?$"


def with_extension(name: Column, plain: Column) -> Column:
    """``plain`` with the extension of ``name`` as it is written there."""
    return F.concat(plain, F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def without_edit(name: Column) -> Column:
    """``IMG-edited(1).jpg`` to ``IMG.jpg``; complete endings only."""
    return with_extension(name, F.regexp_replace(stem(name), ends_with_edit(99), ""))


def without_partial_edit(name: Column) -> Column:
    """As ``without_edit``, and for endings cut off after the dash and a letter or more."""
    return with_extension(name, F.regexp_replace(stem(name), ends_with_edit(2), ""))


def with_restored_extension(name: Column) -> Column:
    """Without the partial ending; then an extension of one to three characters is completed to the first known one."""
    plain = without_partial_edit(name)
    ext = extension(plain)
    known = F.coalesce(*(F.when(F.lit(e).startswith(ext), F.lit(e)) for e in RESTORABLE))
    restored = F.concat(stem(plain), F.lit("."), known)
    return F.when((plain != name) & F.length(ext).between(1, 3) & known.isNotNull(), restored).otherwise(plain)


def without_edge_edit(name: Column) -> Column:
    """For what follows the last dash: Latin letters and spaces, two or more, that begin an edited ending."""
    plain = stem(name)
    latin = plain.rlike(r"-[a-zA-ZÀ-ÖØ-öø-ÿ\s]{2,}(\(\d+\))?$")
    return F.when(latin, with_extension(name, F.regexp_replace(plain, ends_with_edit(3), ""))).otherwise(name)


def motion_photo(name: Column) -> Column:
    """``x.MP`` to ``x.MP.jpg``."""
    return F.when(extension(name) == "mp", F.concat(stem(name), F.lit(".MP.jpg"))).otherwise(name)


def as_heic(name: Column) -> Column:
    """The still that a film or converted picture may share its sidecar with."""
    return F.when(extension(name).isin("mp4", "mov", "jpg", "jpeg", "mp", "mv"), F.concat(stem(name), F.lit(".HEIC"))).otherwise(name)


def is_sub_path(child: Column, parent: Column) -> Column:
    return (child == parent) | child.startswith(F.concat(parent, F.lit("/")))


def rebased(path: Column, old: Column, new: Column) -> Column:
    """``path`` below ``new`` instead of ``old``; as it is when it is not below ``old``."""
    return F.when(is_sub_path(path, old), F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))).otherwise(path)


def replace_last(text: Column, old: str, new: str) -> Column:
    """The last ``old`` only, found literally."""
    at = F.length(text) - F.instr(F.reverse(text), old[::-1]) - (len(old) - 1)
    cut = F.concat(F.substring(text, F.lit(1), at), F.lit(new), F.substring(text, at + len(old) + 1, F.length(text)))
    return F.when(F.instr(text, old) > 0, cut).otherwise(text)


def trimmed_segments(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.rtrim(p)), "/")
