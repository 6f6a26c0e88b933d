"""The whole way from a sheet to answers, through the folder of versioned tables."""

from lodestack.cli import main
from lodestack.kb import KnowledgeBase
from lodestack.settings import Settings
from lodestack.sources.fetching import CaptureFetcher, Response

TEAM = "<html><title>Acme | Leadership</title><body><h1>Leadership</h1><p>Jane Smith</p><p>Chief Executive Officer</p>" + "".join(f"<p>Acme builds rocket number {i} for the northern harbour every year.</p>" for i in range(30)) + '<a href="/team/board">Board</a></body></html>'
BOARD = "<html><title>Board</title><body><h1>Board</h1><p>Bob Jones</p><p>Managing Director</p>" + "".join(f"<p>The board met {i} times to speak about cranes and quays.</p>" for i in range(30)) + "</body></html>"


def test_pipeline(spark, tmp_path, capsys):
    sheet = tmp_path / "urls.csv"
    sheet.write_text("ID,URL\n1,https://acme.example/team\n2,https://acme.example/team/\n3,https://gone.example/\n4,nonsense\n")
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), Settings(max_retries=0, crawl_delay_s=0.0, discover_links=True, max_crawl_depth=1))
    batch = kb.import_sheet(str(sheet))
    b = kb.read("upload_batches").first()
    assert (b.id, b.row_count, b.url_count, b.url_column) == (batch, 4, 2, "URL") and b.rejected_json["not a URL"] == 1
    kb.harvest(CaptureFetcher({"https://acme.example/team": Response(200, "text/html", TEAM.encode()), "https://acme.example/team/board": Response(200, "text/html", BOARD.encode())}))
    state = {r.url: (r.crawl_status, r.crawl_depth) for r in kb.read("harvested_urls").collect()}
    assert state == {"https://acme.example/team": ("SUCCESS", 0), "https://gone.example/": ("FAILED", 0), "https://acme.example/team/board": ("SUCCESS", 1)}
    kb.index()
    kb.extract()
    people = {r.name: (r.title, bool(r.source_chunk_ids)) for r in kb.read("person_records").collect()}
    assert people == {"Jane Smith": ("Chief Executive Officer", True), "Bob Jones": ("Managing Director", True)}
    assert {r.url: r.person_count for r in kb.read("harvested_urls").collect()}["https://acme.example/team"] == 1
    before = kb.read("chunks").count()
    kb.index()
    kb.extract()
    assert kb.read("chunks").count() == before == kb.read("vectors").count() and kb.read("person_records").count() == 2
    top = kb.search("who leads Acme rocket").orderBy("page_rank").first()
    assert top.url == "https://acme.example/team" and top.people[0].name == "Jane Smith"
    kb.reextract()
    assert main(["--root", str(tmp_path / "kb"), "stats"], spark) == 0
    assert "people: 2" in capsys.readouterr().out
    assert main(["--root", str(tmp_path / "kb"), "search", "cranes", "board"], spark) == 0
    assert "https://acme.example/team/board" in capsys.readouterr().out
    assert {r.kind for r in kb.read("harvest_jobs").collect()} == {"harvest", "index", "extract"}
