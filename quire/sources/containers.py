"""Model containers: stored zip files with a canonical model.json and binary members, as a Spark source and sink.

Reading starts from spark.read.format("binaryFile"); writing gives rows (name,
content), byte for byte the same for the same model.
"""

from __future__ import annotations

import io
import json
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.model import mapped

#: Keys without which a file is no model.
REQUIRED = ("schema_version", "source", "pages", "sections", "blocks")
BLOCK = "id string, kind string, page int, section string, text string, confidence float, heading_level int, cells array<array<string>>, image string, label string, caption string, list_ordered boolean, el_group int, bbox array<float>"
SECTION = "id string, level int, title string, parent string, page_start int, page_end int"
PAGE = "n int, width_pts float, height_pts float, labels map<string,string>, ocr_decision string, active_ocr_pass string"
LINK = "page int, uri string, dest_page int, dest_name string, remote_file string"
ASSET = "id string, kind string, storage string, sha256 string, bytes long, width int, height int"
SPACE = "id string, model string, dimension int, normalized boolean, member string, chunk_ids array<string>"


def canonical(model: dict) -> bytes:
    """Sorted keys, two spaces, a newline at the end."""
    return (json.dumps(model, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()


def write_container(model: dict, members: dict[str, bytes]) -> bytes:
    """A stored zip with fixed dates: model.json, then the members by name. Vectors of a wrong size are an error."""
    for space in model.get("embedding_spaces", []):
        want = len(space["chunk_ids"]) * space["dimension"] * 4
        if len(members.get(space["member"], b"")) != want:
            raise ValueError(f"{space['member']} should have {want} bytes")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in [("model.json", canonical(model)), *sorted(members.items())]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def read_container(content: bytes) -> tuple[dict, dict[str, bytes]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            members = {n: z.read(n) for n in z.namelist()}
    except (zipfile.BadZipFile, zlib.error) as e:
        raise ValueError(f"not a container: {e}") from e
    if "model.json" not in members:
        raise ValueError("no model.json")
    model = json.loads(members.pop("model.json"))
    missing = [k for k in REQUIRED if k not in model]
    if missing:
        raise ValueError(f"no model: {', '.join(missing)} missing")
    return model, members


def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the containers under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def models(files: DataFrame, key: str = "path") -> DataFrame:
    """(path, model): the JSON of each container."""

    def each(path, content):
        yield path, canonical(read_container(content)[0]).decode()

    return mapped(files.select(key, "content"), each, f"`{key}` {dict(files.dtypes)[key]}, model string")


def entity(files: DataFrame, name: str, schema: str, key: str = "path") -> DataFrame:
    """The rows of one list of the models: blocks, sections, pages, links, assets, embedding_spaces; ord is their order."""
    part = F.get_json_object("model", f"$.{name}")
    rows = models(files, key).select(key, F.posexplode(F.from_json(part, f"array<struct<{_struct(schema)}>>", {"mode": "FAILFAST"})).alias("ord", "x"))
    return rows.select(key, "ord", "x.*")


def _struct(schema: str) -> str:
    out, depth, cur = [], 0, ""
    for c in schema + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            name, _, kind = cur.strip().partition(" ")
            out.append(f"{name}:{kind}")
            cur = ""
        else:
            cur += c
    return ",".join(out)


def member(files: DataFrame, name: str, key: str = "path") -> DataFrame:
    """(path, bytes): one member of each container, null where there is none."""

    def each(path, content):
        yield path, read_container(content)[1].get(name)

    return mapped(files.select(key, "content"), each, f"`{key}` {dict(files.dtypes)[key]}, bytes binary")


def containers(models_: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, content) from (doc_id, model JSON, members map<string, binary>)."""

    def each(doc, model, members):
        yield doc, write_container(json.loads(model), dict(members or ()))

    return mapped(models_.select(key, "model", "members"), each, f"`{key}` {dict(models_.dtypes)[key]}, content binary")
