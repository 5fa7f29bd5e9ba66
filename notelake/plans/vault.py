"""A vault: a folder of notes, its derived tables, and every query over them."""

from __future__ import annotations

import hashlib
import os
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import okf as O
from ..functions import text as T
from ..functions.fts_query import parse_lenient
from ..model import SCOPES, DocumentFilter
from ..operators import fulltext, graph, history, population, ranking, vector
from ..sources import vault as source
from ..sources.vault import ParseOptions
from .snapshot import Conflict, SnapshotStore

READ_CAP = 262_144
#: How often a refresh starts again after another writer's.
RETRIES = 3
#: Seconds before a scan in which a file may have been written again without its time telling.
UNSURE = 2.0
UNIQUE = {"documents": ["path"], "sections": ["path", "ordinal"], "headings": ["path", "position"]}


class EditError(ValueError):
    """An edit that doesn't apply; ``hint`` tells where its text nearly occurs."""

    def __init__(self, message: str, hint: dict | None = None) -> None:
        super().__init__(message)
        self.hint = hint


class Progress:
    """What runs, what has run and how it ended, for readers of a vault's status.

    Changes made while nothing ran count as absorbed once one scan of the whole folder has ended well.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.in_flight: list[str] = []
        self.whole = self.generation = 0  # scans of the whole folder that run; works that have ended
        self.reconciled = False
        self.errors: dict[str, str | None] = {}

    @contextmanager
    def running(self, name: str, whole: bool = False) -> Iterator[None]:
        with self._lock:
            self.in_flight.append(name)
            self.whole += whole
        error: str | None = None
        try:
            yield
        except BaseException as e:
            error = f"{type(e).__name__}: {e}"
            raise
        finally:
            with self._lock:
                self.in_flight.remove(name)
                self.whole -= whole
                self.generation += 1
                self.errors[name] = error
                self.reconciled |= whole and error is None

    def state(self) -> dict:
        with self._lock:
            offline = "reconciled" if self.reconciled else "reconciling" if self.whole else "not_reconciled"
            return {"offline_changes": offline, "in_flight": list(self.in_flight), "write_generation": self.generation, "last_errors": {k: e for k, e in self.errors.items() if e}}


class Vault:
    """Builds, refreshes and queries. One writer at a time holds the lock; readers see whole generations.

    A provider of embeddings takes a list of texts; its attribute ``identity``, if it has one, names what
    its vectors depend on (provider, model, variant), and vectors of another identity are never mixed in.
    """

    def __init__(self, spark: SparkSession, root: str, store: str, options: ParseOptions = ParseOptions(), embed=None) -> None:
        self.spark, self.root, self.options = spark, root, options
        self.embed = source.backend("embedding", embed) if isinstance(embed, str) else embed  # a registered name, or a function
        self.store = SnapshotStore(spark, store)
        self.dirty: set[str] = set()
        self.hooks: list[source.WriteHook] = []
        self._lock = threading.RLock()
        self.progress = Progress()
        self.embed_batch = 64  # texts a call of the provider; a call that fails leaves them for the next run
        self.fingerprint = options.fingerprint()

    # --- index ------------------------------------------------------------------------------

    def _parsed(self, files: DataFrame, keep: Callable[[DataFrame], DataFrame], known: bool = False) -> DataFrame:
        """Rows of listed files; what is read is parsed in the same task, and only parsed rows are written out."""
        return keep(source.parse(source.scan(files, self.root), self.options, known=known))

    @staticmethod
    def _derive(parsed: DataFrame) -> dict[str, DataFrame]:
        out = source.tables(parsed)
        rows = parsed.filter("skip_category is null").select("path", "title", "folder", F.explode("sections").alias("x")).select("path", "title", "folder", "x.*")
        out["postings"], out["lengths"] = fulltext.build_postings(rows)
        out["names"] = population.name_index(out["documents"])
        return out

    def _empty(self) -> bool:
        return not os.path.isdir(self.root) or not os.listdir(self.root)

    def build(self) -> int:
        """Parse everything into a new generation; an empty folder never replaces an index that holds notes."""
        with self._lock, self.progress.running("build", whole=True), self.store.job() as keep:
            began = time.time()
            files = keep(source.listing(self.spark, self.root, ".md", self.options.excludes, keep))
            if files.isEmpty() and self.store.generation and not self.documents.isEmpty():
                raise RuntimeError("the folder is empty; the index stays")
            size = files.agg(F.sum("size")).first()[0] or 0
            tables = self._derive(self._parsed(self.store.deal(files, "path", size), keep))
            tables["resolved"] = graph.resolve(tables["links"], tables["documents"], tables["aliases"])
            markers = {"built_at": datetime.now(timezone.utc).isoformat(), "walk_complete": True, "scanned_at": began}
            found = self.store.publish(tables, self.fingerprint, markers=markers, unique=UNIQUE, dealt=dict.fromkeys(("sections", "postings"), size))
            self.dirty.clear()
            return found

    def reindex(self, paths: list[str] | DataFrame | None = None, verify: bool = False) -> dict[str, int]:
        """Refresh what changed (or the named paths); counts of added, modified, deleted and unchanged.

        A file is read only if its time or size isn't the stored one, or if it was written so shortly before
        the last scan that its time can't tell; ``verify`` reads all. If another writer publishes
        meanwhile, the refresh starts again from what that one wrote, ``RETRIES`` times at most.
        """
        with self._lock, self.progress.running("reindex", whole=paths is None):
            asked = set(self.dirty)
            for left in range(RETRIES, -1, -1):
                try:
                    counts = self._refresh(paths, verify)
                    break
                except Conflict:
                    if not left:
                        raise
            self.dirty -= asked if paths is None else set(paths) if isinstance(paths, list) else set()
            return counts

    def _refresh(self, paths: list[str] | DataFrame | None, verify: bool) -> dict[str, int]:
        found, began = self.store.manifest(), time.time()
        if not found or found["fingerprint"] != self.fingerprint or not {"resolved", "names"} <= set(found["tables"]):  # other settings derive other rows
            self.build()
            return {"added": self.documents.count(), "modified": 0, "deleted": 0, "unchanged": 0}
        with self.store.job() as keep:
            stored = self.store.read("documents", found)
            before = stored.select("path", "content_hash", "modified_at", F.col("size").alias("_size"))
            if paths is None:
                files = source.listing(self.spark, self.root, ".md", self.options.excludes, keep)
            else:
                asked = paths if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "path string")
                asked = keep(asked.select("path").distinct())
                files, before = source.stat_paths(asked, self.root, self.options.excludes), before.join(asked, "path", "left_semi")
            unsure = F.lit(verify) | (F.col("mtime") >= found["markers"].get("scanned_at", 0) - UNSURE) | (F.col("mtime") != F.col("modified_at")) | ~F.col("size").eqNullSafe(F.col("_size"))
            state = F.when(F.col("mtime").isNull(), "gone").when(F.col("content_hash").isNull() | unsure, "read").otherwise("unchanged")
            seen = keep(files.join(before, "path", "full_outer").withColumn("state", state))
            read = seen.filter("state = 'read'").select("path", "mtime", "size", *(F.col(c).alias(k) for c, k in zip(("content_hash", "modified_at", "_size"), source.KNOWN, strict=True)))
            size = read.agg(F.sum("size")).first()[0] or 0
            parsed = self._parsed(self.store.deal(read, "path", size), keep, known=True)
            fresh = parsed.select("path", F.col("content_hash").alias("_hash"), F.col("modified_at").alias("_time"), F.col("size").alias("_now"))
            same = F.col("_hash") == F.col("content_hash")
            moved = ~(F.col("_time").eqNullSafe(F.col("modified_at")) & F.col("_now").eqNullSafe(F.col("_size")))
            # a file that went between listing and reading has no fresh row: the next refresh decides
            change = F.when(F.col("state") == "gone", "deleted").when(F.col("_hash").isNull() | same, "unchanged").when(F.col("content_hash").isNull(), "added").otherwise("modified")
            changes = keep(seen.join(fresh, "path", "left").select("path", change.alias("change"), F.coalesce(same & moved, F.lit(False)).alias("touched")))
            counts = {"added": 0, "modified": 0, "deleted": 0, "unchanged": 0} | {r.change: r.n for r in history.change_counts(changes).collect()}
            if counts["deleted"] and self._empty():
                raise RuntimeError("the folder is empty; the index stays")
            held = keep(source.not_absent(changes.filter("change = 'deleted'").select("path"), self.root))
            edited = keep(changes.filter("change <> 'unchanged'").join(held, "path", "left_anti").select("path"))
            restamped = edited.unionByName(changes.filter("touched").select("path"))
            if not restamped.isEmpty():
                # rows whose hash isn't the known one are those of edited notes; the others were written again with the same text
                own = self._derive(parsed.filter(~F.col("content_hash").eqNullSafe(F.col("known"))))
                documents = source.tables(parsed)["documents"]
                changed = own | {"documents": (documents, restamped), "resolved": self._resolved_anew(found, own, edited, keep)}
                markers = found["markers"] | ({"scanned_at": began} if paths is None else {})
                self.store.upsert(changed, edited, self.fingerprint, found["generation"], markers, dealt={"sections", "postings"})
            return counts

    def _resolved_anew(self, found: dict, own: dict[str, DataFrame], edited: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(links, sources): the links of all notes in which one may mean another note now, resolved.

        Those are the edited notes, and notes with a link whose target is a path, an end of a path or an
        alias that came or went; no other link is looked up again.
        """
        links, documents, aliases = (self.store.read(t, found) for t in ("links", "documents", "aliases"))
        live = lambda df: population.live(df).select("path")
        once = lambda a, b, *c: a.unionByName(b).groupBy(*c).count().filter("count = 1")
        moved = once(live(documents.join(edited, "path", "left_semi")), live(own["documents"]), "path").select("path")
        old = aliases.join(edited, "path", "left_semi").select("path", "alias").distinct()
        names = once(old, own["aliases"].select("path", "alias").distinct(), "path", "alias").select("alias")
        after = lambda df, new, key: df.join(edited, df[key] == edited["path"], "left_anti").unionByName(new)
        all_links = after(links, own["links"], "source_path")
        sources = keep(edited.unionByName(graph.changed_meaning(all_links, keep(moved), keep(names))).distinct())
        asked = keep(all_links.join(sources, all_links["source_path"] == sources["path"], "left_semi"))
        now = graph.resolve(asked, after(documents, own["documents"], "path"), after(aliases, own["aliases"], "path"), few=True)
        return now, sources

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @property
    def links(self) -> DataFrame:
        """Links with vault-wide targets, as every refresh keeps them."""
        return self.table("resolved")

    def status(self) -> dict:
        """What readers may want to know before they trust an answer: ``stale`` tells of writes that no refresh has taken up."""
        found = self.store.manifest()
        own = {"ready": bool(found), "generation": self.store.generation, "dirty": len(self.dirty), "markers": (found or {}).get("markers", {}), "current_settings": bool(found) and found["fingerprint"] == self.fingerprint}
        state = self.progress.state()
        return own | state | {"stale": bool(self.dirty or state["in_flight"]), "drained": not self.dirty and not state["in_flight"]}

    # --- embeddings -------------------------------------------------------------------------

    def build_vectors(self) -> dict[str, int]:
        """Embed the chunks whose text has no vector yet, reuse the others, and drop those without a note.

        Vectors that aren't finite or have another length than their row's provider gave are left out
        and counted; their chunks are asked for again by the next call.
        """
        if self.embed is None:
            raise RuntimeError("no embedding provider")
        with self._lock, self.progress.running("build_vectors"), self.store.job() as keep:
            found = self.store.manifest() or {"tables": {}}
            rows = self.table("sections").join(population.live(self.documents).select("path", "title", "folder", "content_hash"), "path")
            current = rows.select("path", "ordinal", "folder", F.col("content_hash").alias("token"), vector.embedding_text(rows).alias("embedding_text"))
            identity = getattr(self.embed, "identity", None)
            known = "vectors" in found["tables"] and found["markers"].get("vector_identity") == identity
            stored = self.table("vectors") if known else self.spark.createDataFrame([], current.withColumn("embedding", F.lit(None).cast("array<float>")).schema)
            reused, missing, unbacked = vector.reconcile(current, stored)
            missing = keep(missing.drop("input_hash"))
            # equal texts are embedded once
            asked = missing.select("embedding_text").distinct()
            made = keep(vector.embed(asked, self.embed, batch=self.embed_batch).filter(vector.valid(F.col("embedding"), F.size("embedding"))))
            dimensions = {r[0] for r in made.unionByName(stored.select("embedding_text", "embedding")).select(F.size("embedding")).distinct().limit(2).collect()}
            if len(dimensions) > 1:
                raise vector.BadVector("the provider's vectors have another length than the stored ones, under one identity")
            made = made.withColumn("embedding", vector.unit(F.col("embedding")).cast("array<float>"))
            both = keep(reused.drop("input_hash").unionByName(missing.join(made, "embedding_text").select(*stored.columns)))
            counts = {"reused": reused.count(), "embedded": made.count(), "failed": asked.count() - made.count(), "removed_paths": unbacked.count()}
            if counts["failed"] and not counts["embedded"] and not counts["reused"]:
                raise RuntimeError("the provider embedded none of the texts")
            self.store.publish({"vectors": both}, found["fingerprint"], found["generation"], found["markers"] | {"vector_identity": identity}, {"vectors": ["path", "ordinal"]}, others=True)
            return counts

    # --- exact queries ----------------------------------------------------------------------

    def _population(self, where: DocumentFilter) -> DataFrame:
        hits = None
        if where.query is not None:
            node = parse_lenient(where.query, fulltext.COLUMNS, SCOPES[where.scope])
            empty = self.spark.createDataFrame([], "path string, ordinal int, score double")
            hits = empty if node is None else fulltext.bm25(self.table("postings"), self.table("lengths"), node)
        return population.population(self.documents, self.table("tags"), where, hits, self.table("okf") if where.derived else None)

    def query_documents(self, where: DocumentFilter, limit: int = 50, offset: int = 0, order: str = "auto", sections: int = 0) -> tuple[DataFrame, int]:
        """A page and the exact total, both of one generation."""
        own = self._population(where).persist()
        page = population.page(own, limit, offset, order)
        if sections and where.scope != "metadata":
            scores = None
            if where.query and (node := parse_lenient(where.query, fulltext.COLUMNS, SCOPES[where.scope])):
                scores = fulltext.bm25(self.table("postings"), self.table("lengths"), node)
            page = population.with_sections(page, self.table("sections"), sections, scores)
        return page, own.count()

    def count_documents(self, where: DocumentFilter) -> int:
        return population.count(self._population(where)).first().total

    def aggregate_documents(self, where: DocumentFilter, by: str, tag_key: str | None = None, limit: int = 100) -> DataFrame:
        return population.aggregate(population.group_keys(self._population(where), self.table("tags"), by, tag_key), limit)

    def search_paths(self, query: str, **kw) -> DataFrame:
        index = None if kw.get("candidates") else self.table("names")
        return population.path_search(self.documents, query, index=index, **kw)

    # --- ranked search ----------------------------------------------------------------------

    def _derived(self) -> DataFrame:
        return self.table("okf").select("path", "type", "status", "stale", "trust_tier")

    def _eligible(self, rows: DataFrame, folder: str | None, okf: dict[str, str] | None) -> DataFrame:
        """Rows of live notes in a folder whose metadata is as wanted, with the folder and chunk count."""
        from ..functions.patterns import in_folder

        notes = population.live(self.documents).select("path", "folder", "chunk_count").filter(in_folder(F.col("folder"), folder))
        out = rows.drop("folder", "chunk_count").join(notes, "path")
        if okf:
            derived = self._derived()
            for key, value in okf.items():
                derived = derived.filter(F.col(key) == (O.parse_stale(value) if key == "stale" else value))
            out = out.join(derived.select("path"), "path", "left_semi")
        return out

    def search(self, query: str, mode: str = "auto", limit: int = 10, per_note: int = 2, folder: str | None = None, snippet_words: int = 200, okf_filters: dict[str, str] | None = None, boosts: dict[str, float] | None = None, weights: dict[str, float] | None = None, okf_active: bool = False) -> DataFrame | None:
        """Ranked sections, at most ``per_note`` of ``limit`` notes; None for a blank query."""
        if not query.strip():
            return None
        mode = ranking.resolve_mode(mode, "vectors" in self.store.manifest()["tables"] and self.embed is not None)
        headings = self.table("sections").select("path", "ordinal", "heading", "content")
        channels = []
        if mode in ("keyword", "hybrid"):
            node = parse_lenient(query, fulltext.COLUMNS, SCOPES["all"])
            if node is not None:
                channels.append(("keyword", fulltext.bm25(self.table("postings"), self.table("lengths"), node, weights)))
        if mode in ("semantic", "hybrid"):
            asked = vector.unit_query(self.embed([query])[0])
            q = F.lit(asked).cast("array<double>")
            channels.append(("semantic", self.table("vectors").select("path", "ordinal", vector.dot(F.col("embedding"), q).alias("score"))))
        if not channels:
            return None
        # scores meet the notes alone; texts and metadata join only what a limit leaves
        rows = [(n, ranking.length_downweight(self._eligible(c, folder, okf_filters))) for n, c in channels]
        pool = ranking.candidate_pool(limit, per_note, mode != "keyword", bool(okf_filters))
        if mode == "hybrid" and len(rows) == 2:
            named = headings.select("path", "ordinal", "heading")
            pooled = [ranking.ranked(r, n, pool).join(named, ["path", "ordinal"]) for n, r in rows]
            scored = self._eligible(ranking.rrf(pooled).drop("heading"), folder, None)
        else:
            scored = rows[0][1].withColumn("search_type", F.lit(rows[0][0]))
        if boosts:
            scored = ranking.folder_boost(scored, boosts)
        if okf_active:
            scored = ranking.okf_downweight(scored.join(self._derived(), "path")).drop("type", "status", "stale", "trust_tier")
        top = ranking.collapse(scored, limit, per_note).join(headings, ["path", "ordinal"])
        top = top.join(population.live(self.documents).select("path", "title"), "path").join(self._derived(), "path")
        return fulltext.add_snippets(top, fulltext.query_terms(query), snippet_words).orderBy("file_rank", "note_rank")

    def similar(self, path: str, limit: int = 10, per_note: int = 1) -> DataFrame:
        """Notes nearest to a note's mean vector, without any downweight or boost."""
        pool = ranking.candidate_pool(limit, per_note, True)
        found = vector.attach_live(vector.similar(self.table("vectors"), path, pool), self.documents)
        return ranking.collapse(found.select("path", "ordinal", "score"), limit, per_note)

    def neighbourhood(self, path: str, depth: int = 1, semantic: bool = False, max_nodes: int = 200) -> tuple[DataFrame, DataFrame, bool]:
        """Nodes and edges around a note, and whether there were more; ``semantic`` adds nearest notes where there are vectors."""
        near = None
        if semantic and "vectors" in (self.store.manifest() or {"tables": {}})["tables"]:
            asked = graph.distances(self.links, self.documents, path, depth).orderBy("distance", "path").limit(max_nodes)
            near = vector.near_notes(self.table("vectors"), asked, 5, ranking.candidate_pool(5, 1, True))
        return graph.graph_view(self.links, self.documents, path, depth, max_nodes, near)

    def context(self, path: str, peers: int = 20, limit: int = 5) -> dict[str, DataFrame]:
        """What is known around a note: links in and out, peers, tags, and similar notes where there are vectors."""
        out = graph.context(path, self.links, self.documents, self.table("tags"), peers)
        if "vectors" in (self.store.manifest() or {"tables": {}})["tables"]:
            out["similar"] = self.similar(path, limit)
        return out

    # --- reading ----------------------------------------------------------------------------

    def load(self, path: str) -> dict | None:
        """Text, metadata and etag at any size; None if the note is gone."""
        try:
            data = Path(self.root, path).read_bytes()
        except FileNotFoundError:
            return None
        text = data.decode("utf-8-sig")
        meta, body = M.split_front_matter(text)
        return {"path": path, "text": text, "frontmatter": M.plain(meta), "body": body, "etag": hashlib.sha256(data).hexdigest()}

    def read(self, path: str) -> dict | None:
        """As ``load``, but over the byte cap is an error; sections and edits have no cap."""
        try:
            size = os.stat(Path(self.root, path)).st_size
        except FileNotFoundError:
            return None
        if size > READ_CAP:
            raise ValueError(f"{path} has {size} bytes; read a section")
        return self.load(path)

    def read_section(self, path: str, heading: str) -> str:
        note = self.load(path)
        found = M.section(note["body"], heading) if note else None
        if found is None:
            known = list(dict.fromkeys(h for _, h, _ in M.headings(note["body"])))[:10] if note else []
            raise LookupError(f"no section {heading!r}; there are {known}")
        return found

    def toc(self, path: str, max_level: int = 6) -> list[tuple[int, str]]:
        note = population.lookup(self.documents, path).first()
        if note is None:
            raise LookupError(path)
        rows = self.table("headings").filter(F.col("path") == path).orderBy("position").collect()
        return M.outline(note.title, [(r.heading_level, r.heading) for r in rows], max_level)

    def citing(self, resource: str, okf_active: bool = True) -> DataFrame:
        """Labels of the notes that declare a source: matched ones cite it, all others are diagnostics (column ``cites``).

        Files that only navigate are left out where maintained metadata is in force.
        """
        if not resource.strip():
            raise ValueError("the resource is blank")
        c = self.table("citations")
        declared = c.filter((F.col("status") == "declared") & (F.col("resource") == resource)).select("path").distinct()
        own = c.join(declared, "path").filter((F.col("resource") == resource) | ((F.col("resource") == "") & (F.col("status") != "declared")))
        own = own.filter(~ranking.is_reserved(F.col("path"))) if okf_active else own
        return own.withColumn("cites", F.col("status") == "matched").orderBy("path", "label")

    def okf_stats(self) -> dict[str, DataFrame]:
        o = self.table("okf").filter("status is not null")
        return {k: o.groupBy(k).count().orderBy(k) for k in ("type", "status", "stale", "trust_tier")}

    def okf_audit(self, examples: int = 20) -> DataFrame:
        """Findings with how many notes have them and the first examples by path."""
        rows = self.table("okf").select("path", F.explode("findings").alias("rule"))
        from pyspark.sql import Window

        first = F.row_number().over(Window.partitionBy("rule").orderBy("path")) <= examples
        shown = rows.withColumn("_shown", first).groupBy("rule")
        return shown.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("_shown"), F.col("path")))).alias("examples")).orderBy("rule")

    def stats(self) -> dict:
        row = graph.counts(self.links, self.documents, self.table("sections")).first().asDict()
        return row | {"folders": population.distinct_folders(self.documents).count(), "skipped": population.skipped(self.documents).count()}

    def conventions(self, path: str, name: str = "CONVENTIONS.md") -> list[str]:
        """Convention files from the root down to the note's folder."""
        parts = path.split("/")[:-1]
        wanted = ["/".join([*parts[:k], name]) for k in range(len(parts) + 1)]
        return [w for w in wanted if Path(self.root, w).is_file()]

    def history(self, path: str | None = None, folder: str | None = None, since: float | None = None, until: float | None = None, limit: int = 20) -> DataFrame:
        """Commits of a note under all its names, of a folder, or of the vault, newest first."""
        return history.history(source.git_log(self.spark, self.root, path=path), None, folder, since, until, limit)

    # --- writing ----------------------------------------------------------------------------

    def _file(self, path: str) -> Path:
        full = Path(self.root, path).resolve()
        if not full.is_relative_to(Path(self.root).resolve()) or not path.endswith(".md"):
            raise ValueError(f"not a note of this vault: {path}")
        return full

    def _check(self, path: str, etag: str | None) -> str:
        note = self.load(path)
        if note is None:
            raise FileNotFoundError(path)
        if etag is not None and etag != note["etag"]:
            raise RuntimeError(f"{path} has changed")
        return note["text"]

    def write(self, path: str, text: str, etag: str | None = None) -> str:
        """Write a whole note; with an etag only over that version. Returns the new etag."""
        full = self._file(path)
        with self._lock:
            if etag is not None:
                self._check(path, etag)
            full.parent.mkdir(parents=True, exist_ok=True)
            new = full.with_name(f".{full.name}.new")
            new.write_text(text, encoding="utf-8", newline="")
            os.replace(new, full)
            self.dirty.add(path)
        for hook in self.hooks:
            hook(path)
        return hashlib.sha256(full.read_bytes()).hexdigest()

    def edit(self, path: str, old: str, new: str, etag: str | None = None) -> str:
        """Replace the one place where ``old`` occurs, exactly or else in normal form."""
        text = self._check(path, etag)
        n = text.count(old) if old else 0
        if n == 1:
            return self.write(path, text.replace(old, new))
        places = T.find_normal(text, old) if not n else []
        if len(places) == 1:
            return self.write(path, M.splice(text, [(*places[0], new)]))
        raise EditError("the text occurs several times" if n > 1 or places else "the text doesn't occur", T.closest(text, old))

    def append(self, path: str, text: str, etag: str | None = None) -> str:
        own = self._check(path, etag)
        return self.write(path, own + ("" if own.endswith("\n") or not own else "\n") + text)

    def delete(self, path: str, etag: str | None = None) -> None:
        self._check(path, etag)
        self._file(path).unlink()
        self.dirty.add(path)

    def move(self, moved: dict[str, str]) -> list[str]:
        """Move notes and rewrite every link to them; nothing happens if a new name is taken. Returns the notes rewritten."""
        taken = [new for new in moved.values() if Path(self.root, new).exists() and new not in moved]
        if taken or len(set(moved.values())) != len(moved):
            raise FileExistsError(", ".join(taken) or "two notes with one new name")
        with self._lock:
            pointing = self.links.filter(F.col("target_path").isin(list(moved))).select("source_path").distinct()
            sources = {r.source_path for r in pointing.collect()} | set(moved)
            for old, new in moved.items():
                self._file(new).parent.mkdir(parents=True, exist_ok=True)
                os.replace(self._file(old), self._file(new))
            rewritten = []
            for path in sorted(sources):
                now = moved.get(path, path)
                text = self._file(now).read_text(encoding="utf-8")
                changed = M.rewrite_links(text, path, moved, now)
                if changed != text:
                    self.write(now, changed)
                    rewritten.append(now)
            self.dirty |= set(moved) | set(moved.values())
        return rewritten

    def move_folder(self, old: str, new: str) -> list[str]:
        rows = population.population(self.documents, self.table("tags"), DocumentFilter(folder=old)).select("path").collect()
        return self.move({r.path: new + r.path[len(old) :] for r in rows})

    def flush(self) -> dict[str, int]:
        """Refresh the notes written since the last refresh."""
        return self.reindex(sorted(self.dirty)) if self.dirty else {}

    def export(self, target: str) -> int:
        """A ZIP of all notes, wikilinks as Markdown links, and all attachments, with fixed times; how many notes it holds."""
        import heapq
        import shutil
        import zipfile

        resolved: dict[str, dict[str, str]] = {}
        raw = self.table("links").filter("link_type = 'wikilink'").select("source_path", "link_ordinal", F.col("target_path").alias("name"))
        for r in raw.join(self.links.select("source_path", "link_ordinal", "target_path"), ["source_path", "link_ordinal"]).toLocalIterator():
            resolved.setdefault(r.source_path, {})[r.name] = r.target_path
        notes = ((row.path, True) for row in population.live(self.documents).select("path").orderBy("path").toLocalIterator())
        files = ((row.path, False) for row in source.attachments(self.spark, self.root, self.options).select("path").toLocalIterator() if not row.path.endswith(".md"))
        n = 0
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for path, is_note in heapq.merge(notes, files):
                info = zipfile.ZipInfo(path)
                if is_note:
                    text = self._file(path).read_text(encoding="utf-8")
                    z.writestr(info, M.wikilinks_to_markdown(text, path, resolved.get(path, {}))[0])
                    n += 1
                elif (own := Path(self.root, path)).resolve() != Path(target).resolve():
                    info.file_size = own.stat().st_size
                    with own.open("rb") as data, z.open(info, "w") as out:
                        shutil.copyfileobj(data, out)
        return n
