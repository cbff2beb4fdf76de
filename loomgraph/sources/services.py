"""Services over HTTP: calls with retries, a chat client, an association network as a data source, look-ups beside a cache, and presets.

Everything runs where it is called, on the driver or in a worker. Keys come from the environment of that process and are never part of a plan.
"""

from __future__ import annotations

import json
import os
import random
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.construction import cache_aside
from ..operators.models import EchoClient, LlmClient, strip_reasoning
from ..runtime import saved, ship

#: Answers that are worth another try, besides those of 500 and above.
AGAIN = (408, 429)
TIMEOUT, TRIES, PAUSE, LONGEST = 30.0, 4, 0.5, 20.0


def pause(attempt: int, first: float = PAUSE) -> float:
    """Seconds to wait after a failed attempt, counted from 0: twice as long each time, by chance up to a quarter more."""
    return min(LONGEST, first * 2**attempt) * (1 + random.random() / 4)


def retried(call: Callable, tries: int = TRIES, first: float = PAUSE):
    """The result of a call that is repeated after failures that may pass: refused or broken connections, timeouts, and answers that ask for it."""
    for attempt in range(tries):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN and e.code < 500 or attempt == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError, EmptyAnswer):
            if attempt == tries - 1:
                raise
        time.sleep(pause(attempt, first))
    raise ValueError("tries must be positive")


class EmptyAnswer(RuntimeError):
    """A model's answer without content."""


def open_json(url: str, *, method: str = "GET", data: object = None, headers: dict[str, str] | None = None, timeout: float = TIMEOUT, tries: int = TRIES, first: float = PAUSE):
    """The JSON that a service answers; data is sent as JSON."""
    body = None if data is None else json.dumps(data).encode()
    request = urllib.request.Request(url, body, {"Accept": "application/json", **({"Content-Type": "application/json"} if body else {}), **(headers or {})}, method=method)

    def call():
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read().decode("utf-8"))

    return retried(call, tries, first)


def host_resolves(url: str) -> bool:
    """Whether a service's host has an address; if not, what is cached must do."""
    try:
        return bool(socket.getaddrinfo(urllib.parse.urlsplit(url).hostname, None))
    except (OSError, UnicodeError):
        return False


def head_ok(url: str, timeout: float = 5.0) -> bool:
    """Whether a service answers at all."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as answer:
            return answer.status < 400
    except (OSError, ValueError):
        return False


class ChatClient:
    """A client of a chat completion service. The key stands in an environment variable, so that it never travels with the client."""

    def __init__(self, url: str, model: str, *, key_variable: str | None = None, temperature: float = 0.0, timeout: float = 180.0, tries: int = 3, first: float = PAUSE):
        self.url, self.model, self.key, self.temperature, self.timeout, self.tries, self.first = url.rstrip("/"), model, key_variable, temperature, timeout, tries, first

    def complete(self, prompt: str, system: str | None = None) -> str:
        messages = [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}]
        headers = {"Authorization": f"Bearer {os.environ[self.key]}"} if self.key else {}

        def call() -> str:
            answer = open_json(f"{self.url}/chat/completions", method="POST", data={"model": self.model, "messages": messages, "temperature": self.temperature}, headers=headers, timeout=self.timeout, tries=1)
            content = strip_reasoning((answer.get("choices") or [{}])[0].get("message", {}).get("content") or "")
            if not content:
                raise EmptyAnswer("the model's answer is empty")
            return content

        return retried(call, self.tries, self.first)


_loaded: dict[str, LlmClient] = {}


class LocalClient:
    """A model that a worker loads when it is first asked and keeps: load makes an object with the method complete."""

    def __init__(self, name: str, load: Callable[[], LlmClient]):
        self.name, self.load = name, load

    def ready(self) -> LlmClient:
        """The model, loaded once for each process."""
        if self.name not in _loaded:
            _loaded[self.name] = self.load()
        return _loaded[self.name]

    def complete(self, prompt: str, system: str | None = None) -> str:
        return strip_reasoning(self.ready().complete(prompt, system))


def client(provider: str = "echo", **options) -> LlmClient:
    """The client of a provider: echo (offline), http or local."""
    known = {"echo": EchoClient, "http": ChatClient, "local": LocalClient}
    if provider not in known:
        raise ValueError(f"unknown provider {provider!r}")
    return known[provider](**options)


class _Batch(InputPartition):
    def __init__(self, symbols: list[str]):
        self.symbols = symbols


class _AssociationReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Batch]:
        symbols = [s for s in self.options["symbols"].split(",") if s]
        size = int(self.options.get("batch", "50"))
        return [_Batch(symbols[at : at + size]) for at in range(0, len(symbols), size)] or [_Batch([])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        if not partition.symbols:
            return
        asked = {"identifiers": ",".join(partition.symbols), "species": self.options.get("species", "9606"), "required_score": self.options.get("least_score", "800"), "add_nodes": self.options.get("add_nodes", "10")}
        for row in open_json(f"{self.options['url']}?{urllib.parse.urlencode(asked)}", tries=int(self.options.get("tries", TRIES)), first=float(self.options.get("pause", PAUSE))):
            yield row.get("a"), row.get("b"), None if row.get("score") is None else float(row["score"])


class AssociationSource(DataSource):
    """An association network that a service answers for batches of symbols, one call for each partition. Options: url, symbols, batch, species, least_score, add_nodes."""

    @classmethod
    def name(cls) -> str:
        return "associations"

    def schema(self) -> str:
        return "a string, b string, score double"

    def reader(self, schema) -> DataSourceReader:
        return _AssociationReader(dict(self.options))


def associations(spark: SparkSession, url: str, symbols: list[str], **options) -> DataFrame:
    """(a, b, score) of the service's network around the symbols."""
    ship(spark)
    spark.dataSource.register(AssociationSource)
    return spark.read.format("associations").options(url=url, symbols=",".join(symbols), **options).load()


class Lookup(Protocol):
    """What a service tells of a key: schema names its columns, the key's own first."""

    url: str
    schema: str

    def rows(self, key: str) -> list[tuple]: ...


class GeneIds:
    """(gene, gene_id): the first stable gene identifier of a symbol."""

    schema = "gene string, gene_id string"

    def __init__(self, url: str, prefix: str = "ENSG", **calls):
        self.url, self.prefix, self.calls = url, prefix, calls

    def rows(self, key: str) -> list[tuple]:
        told = open_json(f"{self.url}/{urllib.parse.quote(key)}?content-type=application/json", **self.calls)
        found = (x.get("id") for x in told if isinstance(x, dict) and x.get("type") == "gene")
        return [(key, i) for i in found if isinstance(i, str) and i.startswith(self.prefix)][:1]


class Pathways:
    """(gene, pos, pathway_id, name, fdr): the first pathways of a gene by their false discovery rate."""

    schema = "gene string, pos int, pathway_id string, name string, fdr double"

    def __init__(self, url: str, size: int = 3, **calls):
        self.url, self.size, self.calls = url, max(1, size), calls

    def rows(self, key: str) -> list[tuple]:
        asked = {"interactors": "false", "pageSize": str(self.size), "page": "1", "sortBy": "ENTITIES_FDR", "order": "ASC", "species": "Homo sapiens", "resource": "TOTAL", "pValue": "1", "includeDisease": "true"}
        told = open_json(f"{self.url}/{urllib.parse.quote(key)}?{urllib.parse.urlencode(asked)}", **self.calls)
        listed = told.get("pathways") if isinstance(told, dict) else None
        out = []
        for p in (listed or [])[: self.size]:
            if name := p.get("stId") or p.get("dbId"):
                fdr = (p.get("entities") or {}).get("fdr") if isinstance(p.get("entities"), dict) else p.get("fdr")
                out.append((key, len(out), str(name), str(p.get("name") or ""), None if fdr is None else float(fdr)))
        return out


class Drugs:
    """(gene_id, pos, drug_id, drug, phase, mechanism, disease): the drugs known for a target, in the service's order."""

    schema = "gene_id string, pos int, drug_id string, drug string, phase double, mechanism string, disease string"
    QUERY = "query($id: String!, $size: Int!) { target(ensemblId: $id) { knownDrugs(size: $size) { rows { drug { id name maximumClinicalTrialPhase } disease { name } mechanismOfAction } } } }"

    def __init__(self, url: str, size: int = 50, **calls):
        self.url, self.size, self.calls = url, size, calls

    def rows(self, key: str) -> list[tuple]:
        told: object = open_json(self.url, method="POST", data={"query": self.QUERY, "variables": {"id": key, "size": self.size}}, **self.calls)
        for step in ("data", "target", "knownDrugs", "rows"):
            told = told.get(step) if isinstance(told, dict) else None
        out = []
        for r in told if isinstance(told, list) else []:
            drug = r.get("drug") or {}
            phase = drug.get("maximumClinicalTrialPhase")
            out.append((key, len(out), drug.get("id"), drug.get("name"), None if phase is None else float(phase), r.get("mechanismOfAction"), (r.get("disease") or {}).get("name")))
        return out


class Accessions:
    """(gene, accession): the first reviewed protein of a gene."""

    schema = "gene string, accession string"

    def __init__(self, url: str, organism: str = "9606", **calls):
        self.url, self.organism, self.calls = url, organism, calls

    def rows(self, key: str) -> list[tuple]:
        asked = {"query": f"gene_exact:{key} AND organism_id:{self.organism} AND reviewed:true", "fields": "accession", "format": "json", "size": "1"}
        told = open_json(f"{self.url}?{urllib.parse.urlencode(asked)}", **self.calls)
        return [(key, r["primaryAccession"]) for r in (told.get("results") or []) if r.get("primaryAccession")][:1]


def looked_up(keys: DataFrame, key: str, lookup: Lookup, workers: int = 8) -> DataFrame:
    """The service's rows for distinct keys: each worker asks for a batch, a few calls at once, so that workers times their number bounds the calls."""
    ship(keys.sparkSession)
    columns = [c.split()[0] for c in lookup.schema.split(", ")]

    def run(batches):
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for b in batches:
                told = [r for rows in pool.map(lookup.rows, b.column(0).to_pylist()) for r in rows]
                yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in told], schema=fields)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(lookup.schema))
    return keys.select(F.trim(F.col(key)).alias("k")).filter("k <> ''").distinct().mapInArrow(run, lookup.schema)


def cached_lookup(requested: DataFrame, cache: DataFrame, lookup: Lookup, key: str, workers: int = 8) -> tuple[DataFrame, DataFrame]:
    """(answers for the requested keys, rows to add to the cache): only keys that the cache lacks are asked for, and none where the service can't be reached. The new rows are saved before they are read twice."""
    reachable = host_resolves(lookup.url) and head_ok(lookup.url)

    def fetch(missing: DataFrame) -> DataFrame:
        return saved(looked_up(missing, key, lookup, workers), "lookup") if reachable else requested.sparkSession.createDataFrame([], lookup.schema)

    return cache_aside(requested, cache, fetch, key)


def preset(path: str, name: str, defaults: dict) -> dict:
    """The defaults with what the preset of that name in a JSON file of presets sets; a name that is not there, or a setting that has no default, is an error."""
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    if name not in known:
        raise KeyError(f"no preset {name!r}")
    if unknown := sorted(set(known[name]) - set(defaults)):
        raise ValueError(f"unknown settings {unknown}")
    return {**defaults, **known[name]}
