"""A paged search service as a data source, in batches and as a stream.

`PagedSource` ("paged") gives a row for each page with the answer as it came. `PagedRecords` ("paged_records") gives a row for each record,
and works in batches, whose filters become request parameters and so fewer pages, and as a stream, which goes on where it ended.

    spark.dataSource.register(PagedRecords)
    spark.read.format("paged_records").option("fetch", given(function)).load().filter("issue_date >= '2024-01-05' and org in ('7', '9')")
    spark.readStream.format("paged_records").option("fetch", given(function)).option("progress", folder).load()

Filters are sent along with spark.sql.python.filterPushdown.enabled. The fetch function takes the request's parameters and returns the
answer's text; it may raise OSError, which is retried. It is named "module:function", or shipped by value with given().
"""

from __future__ import annotations

import base64
import datetime
import importlib
import itertools
import json
import time

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.ingest import LISTS, WRAPPERS
from ..store import opened

# Fixed values of the service's protocol.
PAGE_SIZE, MOST_PAGES, TRIES = 20, 3, 4
#: Records that one request asks for at most; larger pages are asked for in parts.
MOST_ASKED = 2000
SENT = ("org", "status", "from_date", "to_date")


class Page(InputPartition):
    pass


def fetch_with_retries(fetch, params: dict, tries: int = TRIES, pause=time.sleep) -> str:
    """Waits 1, 2, 4 ... seconds between tries; an answer that isn't JSON counts as a failure."""
    for i in range(tries):
        try:
            body = fetch(params)
            if body.lstrip()[:1] not in ("{", "["):
                raise OSError("no JSON in the answer")
            return body
        except OSError as e:
            if i + 1 == tries:
                raise RuntimeError(f"the request failed {tries} times") from e
            pause(2**i)
    raise AssertionError


def given(function) -> str:
    """A fetch function as an option's value."""
    return "pickle:" + base64.b64encode(cloudpickle.dumps(function)).decode()


def named(option: str):
    kind, _, rest = option.partition(":")
    return cloudpickle.loads(base64.b64decode(rest)) if kind == "pickle" else getattr(importlib.import_module(kind), rest)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = {k.lower(): v for k, v in options.items()}
        self.params: dict = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in SENT:
                self.params[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self):
        return [Page(i) for i in range(int(self.options.get("pages", MOST_PAGES)))]

    def read(self, partition):
        fetch = named(self.options["fetch"])
        time.sleep(float(self.options.get("delay", 0)))
        params = self.params | {"page": partition.value, "size": int(self.options.get("size", PAGE_SIZE))}
        body = fetch_with_retries(fetch, params, int(self.options.get("tries", TRIES)))
        yield (partition.value, *(str(self.params.get(k, "")) for k in SENT), body)


class PagedSource(DataSource):
    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "page int, org string, status string, from_date string, to_date string, payload string"

    def reader(self, schema):
        return PagedReader(self.options)


def records_of(body: str) -> list:
    """The records of an answer: the list itself, the first list under one of LISTS, or those of what one of WRAPPERS holds."""
    return _records(json.loads(body))


def _records(found) -> list:
    if isinstance(found, list):
        return [x for x in found if isinstance(x, dict)]
    if not isinstance(found, dict):
        return []
    for k in LISTS:
        if isinstance(found.get(k), list):
            return _records(found[k])
    for k in WRAPPERS:
        if isinstance(found.get(k), dict) and found[k]:
            return _records(found[k])
    return []


class Service:
    """Requests for pages of records, at most one in `delay` seconds from one task.

    Records are numbered by pages of `size`, but no request asks for more than `part` (option `request`) of them, so that a task holds one answer
    of bounded size however large the pages are.
    """

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.size = int(self.options.get("size", PAGE_SIZE))
        self.part = min(self.size, int(self.options.get("request", MOST_ASKED)))
        self.tries = int(self.options.get("tries", TRIES))
        self.delay = float(self.options.get("delay", 0))
        self.fetch = named(self.options["fetch"])
        self.asked = 0

    def page(self, params: dict, number: int) -> list:
        """Answer of that number, of `part` records each."""
        if self.asked:
            time.sleep(self.delay)
        self.asked += 1
        return records_of(fetch_with_retries(self.fetch, params | {"page": number, "size": self.part}, self.tries))

    def length(self, params: dict, first: int, after: int) -> int:
        """Records before the first page from `first` that isn't full, looked for before page `after`. Pages are full up to the last."""
        return min(self._length(params, first * self.size // self.part, -(-after * self.size // self.part)), after * self.size)

    def _length(self, params: dict, first: int, after: int) -> int:
        low, high, rest = first, after, 0
        while low < high:
            middle = (low + high) // 2
            n = len(self.page(params, middle))
            if n >= self.part:
                low = middle + 1
            else:
                high, rest = middle, n
        return low * self.part + (rest if low < after else 0)

    def records(self, params: dict) -> int:
        """How many records there are: answers twice as far until one isn't full, then between."""
        step = 1
        while len(self.page(params, step - 1)) >= self.part:
            step *= 2
        return self._length(params, step // 2, step)

    def pages(self, params: dict) -> int:
        """How many pages hold records."""
        return -(-self.records(params) // self.size)

    def row(self, number: int, position: int, record: dict) -> tuple:
        shown = lambda x: None if x is None else str(x)
        org, status, day = (record.get(self.options.get(f"{k}_field", name)) for k, name in FIELDS.items())
        try:
            day = datetime.date.fromisoformat(str(day)[:10])
        except ValueError:
            day = None
        return number, position, shown(org), shown(status), day, json.dumps(record, ensure_ascii=False)


#: Which of a record's fields are columns, unless the options org_field, status_field and date_field say otherwise.
FIELDS = {"org": "organizationId", "status": "status", "date": "issueDate"}


class Run(InputPartition):
    """Answers (parts of pages, where those are large) that a task asks for, one after the other; of the first and last one records from `first` up to `last` only."""

    def __init__(self, params: dict, pages: list[int], first: int = 0, last: int | None = None):
        self.params, self.pages, self.first, self.last = params, pages, first, last


def asked_for(service: Service, run: Run):
    for p in run.pages:
        for i, r in enumerate(service.page(run.params, p)):
            n = p * service.part + i
            if n >= run.first and (run.last is None or n < run.last):
                yield service.row(n // service.size, n % service.size, r)


def dealt(pages: list[int], tasks: int) -> list[list[int]]:
    """Pages in runs, as many as tasks at most."""
    n = -(-len(pages) // max(1, tasks))
    return [pages[i : i + n] for i in range(0, len(pages), n)] if pages else []


class RecordsReader(DataSourceReader):
    """Filters on org and status (equality, lists) and on the first and last issue_date become parameters of the request.

    Spark still applies them all to what comes, so a service that ignores one, or takes a bound inclusively, gives no wrong row.
    """

    def __init__(self, options: dict):
        self.options = options
        self.values: dict[str, set] = {}
        self.first: datetime.date | None = None
        self.last: datetime.date | None = None

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("org", "status") and isinstance(f, (EqualTo, In)):
                mine = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.values[name] = self.values[name] & mine if name in self.values else mine
            if name == "issue_date":
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first or f.value, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last or f.value, f.value)
            yield f

    def requests(self) -> list[dict]:
        dates = {k: v.isoformat() for k, v in (("from_date", self.first), ("to_date", self.last)) if v}
        names = sorted(self.values)
        return [dates | dict(zip(names, x, strict=True)) for x in itertools.product(*(sorted(self.values[k], key=str) for k in names))]

    def partitions(self):
        service = Service(self.options)
        tasks = int(service.options.get("tasks", 8))
        found = [Run(r, run) for r in self.requests() for run in dealt(list(range(-(-service.records(r) // service.part))), tasks)]
        return found or [Run({}, [])]

    def read(self, partition):
        yield from asked_for(Service(self.options), partition)


class RecordsStream(DataSourceStreamReader):
    """Records in order of pages, as a stream whose offsets are numbers of records: it can end within a page and go on there.

    A micro-batch takes `batch` pages at most, and a run of the query `pages` (no bound unless given); it ends at a short or empty page.
    Tasks ask for the pages; the driver asks only how far they are full, which takes some log2(batch) requests a batch. The
    engine keeps offsets in its checkpoint but doesn't tell them before it asks for the newest, so the last one planned is also kept
    in the folder `progress`. Options org, status, from_date and to_date are sent along.
    """

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.service = Service(options)
        self.params = {k: self.options[k] for k in SENT if k in self.options}
        self.batch = int(self.options.get("batch", 8))
        self.at: int | None = None
        self.most: int | None = None

    def place(self):
        fs, path = opened(self.options["progress"])
        return fs, path, f"{path.rstrip('/')}/offset"

    def known(self) -> int:
        fs, _, file = self.place()
        try:
            with fs.open_input_stream(file) as f:
                return json.loads(f.read())["record"]
        except FileNotFoundError:
            return 0

    def keep(self, end: int) -> None:
        fs, path, file = self.place()
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(file) as f:
            f.write(json.dumps({"record": end}).encode())

    def initialOffset(self):
        return {"record": 0}

    def latestOffset(self):
        if self.at is None:
            self.at = self.known()
        if self.most is None and "pages" in self.options:
            self.most = self.at + int(self.options["pages"]) * self.service.size
        first = self.at // self.service.size
        end = max(self.at, self.service.length(self.params, first, first + self.batch))
        if self.most is not None:
            end = max(self.at, min(end, self.most))
        self.at = end
        return {"record": end}

    def partitions(self, start, end):
        self.at = max(self.at or 0, end["record"])
        self.keep(end["record"])
        low, high, part = start["record"], end["record"], self.service.part
        pages = list(range(low // part, -(-high // part))) if high > low else []
        return [Run(self.params, run, low, high) for run in dealt(pages, int(self.options.get("tasks", 8)))]

    def read(self, partition):
        yield from asked_for(Service(self.options), partition)

    def commit(self, end):
        pass


class PagedRecords(DataSource):
    @classmethod
    def name(cls):
        return "paged_records"

    def schema(self):
        return "page long, position int, org string, status string, issue_date date, record string"

    def reader(self, schema):
        return RecordsReader(self.options)

    def streamReader(self, schema):
        return RecordsStream(self.options)
