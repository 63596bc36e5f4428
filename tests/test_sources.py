import json

from pyspark.sql import functions as F

from auditloom.operators import events as ev
from auditloom.sources import cdm, dot, edges, optc, techniques

NS = "com.bbn.tc.schema.avro.cdm18."


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_edge_tsv_cases(spark, tmp_path):
    text = (
        "A1\tSUBJECT_PROCESS\tF1\tFILE_OBJECT_BLOCK\tEVENT_WRITE\t1520000000000000001\n"
        "A1\tSUBJECT_PROCESS\tF1\tFILE_OBJECT_BLOCK\tEVENT_WRITE\t1520000000000000001\n"
        "A1\tSUBJECT_PROCESS\tF1\n"
        "A2\tSUBJECT_PROCESS\tF2\tFILE_OBJECT_BLOCK\tEVENT_READ\tnot-a-number\n\n"
    )
    rows = edges.read_edge_tsv(spark, write(tmp_path, "e.tsv", text)).collect()
    assert len(rows) == 3
    assert sorted(str(r.ts_us) for r in rows) == ["1520000000000000", "1520000000000000", "None"]


def _event(second=False, path=True, props=True):
    e = {
        "type": "EVENT_READ",
        "subject": {NS + "UUID": "A"},
        "predicateObject": {NS + "UUID": "B"},
        "predicateObject2": {NS + "UUID": "C"} if second else None,
        "timestampNanos": 1520000000000000001,
        "properties": {"map": {"cmdLine": "ls -l"}} if props else None,
        "predicateObjectPath": {"string": "/b"} if path else None,
        "predicateObject2Path": {"string": "/c"},
    }
    return json.dumps({"datum": {NS + "Event": e}})


def test_cdm_events(spark, tmp_path):
    lines = [_event(), _event(second=True), _event(path=False, props=False), '{"datum": EVENT broken', '{"datum":{"x":1}}']
    rows = cdm.read_events(spark, write(tmp_path, "e.json", "\n".join(lines)), 18).collect()
    assert sorted((r.object_id, r.path, r.exec) for r in rows) == [
        ("B", "", ""), ("B", "/b", "ls -l"), ("B", "/b", "ls -l"), ("C", "/c", "ls -l"),
    ]


def test_cdm_entities(spark, tmp_path):
    def rec(name, body):
        return '{"datum":{"' + NS + name + '":' + json.dumps(body, separators=(",", ":")) + "}}"

    lines = [
        rec("NetFlowObject", {"uuid": "N", "localAddress": "1.1.1.1", "localPort": 5, "remoteAddress": "2.2.2.2", "remotePort": 80, "x": 1}),
        rec("Subject", {"uuid": "S", "cmdLine": {"string": "bash -c x"}, "properties": {"map": {"tgid": "7"}}}),
        rec("Subject", {"uuid": "T", "cmdLine": {"string": "vim"}, "properties": {"map": {"tgid": "8", "path": "/bin/vim"}}}),
        rec("Subject", {"uuid": "U", "cmdLine": None, "properties": {"map": {"tgid": "8"}}}),
        rec("FileObject", {"uuid": "F", "baseObject": {"properties": {"map": {"filename": "/etc/hosts"}}}}),
    ]
    rows = cdm.read_entities18(spark, write(tmp_path, "n.json", "\n".join(lines))).collect()
    assert {(r.uuid, r.kind, r.props) for r in rows} == {
        ("N", "net", "1.1.1.1,5,2.2.2.2,80"), ("S", "subject", "bash -c x,7,null"), ("T", "subject", "vim,8,/bin/vim"),
        ("F", "file", "/etc/hosts"),
    }


def test_merge_entities_first_file_last_record(spark):
    rows = [("x", "file", "1", "f1", "1"), ("x", "file", "2", "f1", "2"), ("x", "file", "3", "f2", "9")]
    df = spark.createDataFrame(rows, "uuid string, kind string, props string, source_file string, record_key string")
    assert ev.merge_entities(df).collect()[0].props == "2"


def test_preferred_entities_order_and_empty(spark):
    rows = [("a", "file", "f"), ("a", "net", "n"), ("b", "net", ""), ("b", "subject", "s")]
    df = spark.createDataFrame(rows, "uuid string, kind string, props string")
    assert {(r.name, r.props) for r in ev.preferred_entities(df).collect()} == {("a", "n"), ("b", "s")}


def test_optc_records_in_all_layouts(spark, tmp_path):
    def rec(i):
        return json.dumps({"action": "OPEN", "actorID": f"a{i}", "objectID": f"o{i}", "object": "FILE", "properties": {"file_path": f"/f{i}"}})

    text = rec(1) + "\n" + rec(2) + " " + rec(3) + rec(4) + "\n[" + rec(5) + ", " + rec(6) + "]\n\nnot json\n"
    rows = optc.read_records(spark, write(tmp_path, "r.json", text)).collect()
    assert sorted(r.objectID for r in rows) == [f"o{i}" for i in range(1, 7)]
    pretty = json.dumps([json.loads(rec(7)), json.loads(rec(8))], indent=2)
    many = optc.read_records(spark, write(tmp_path, "p.json", pretty), multi_line=True)
    assert sorted(r.props for r in optc.entities(many).collect()) == ["/f7", "/f8"]


def test_dot_graph(spark, tmp_path):
    text = (
        '"p 1" [type="process"];\n"10.0.0.1" [type="IP_Address"];\n"p 1" -> "10.0.0.1" [capacity=1, type="connect", timestamp=12];\n'
        '"ghost" -> "p 1" [capacity=1, type="fork", timestamp=13];\n'
    )
    path = write(tmp_path, "g.dot", text)
    nodes = dot.read_nodes(spark, path)
    assert {(r.name, r.kind) for r in nodes.collect()} == {("p 1", "subject"), ("10.0.0.1", "net")}
    got = {(r.actor_id, r.actor_type, r.object_type, r.ts) for r in dot.read_edges(spark, path, nodes).collect()}
    assert got == {("p 1", "SUBJECT_PROCESS", "NETFLOW_OBJECT", 12), ("ghost", "PRINCIPAL_LOCAL", "SUBJECT_PROCESS", 13)}


def test_labels_and_scenes(spark, tmp_path):
    (tmp_path / "one" / "benign").mkdir(parents=True)
    (tmp_path / "one" / "malicious").mkdir()
    (tmp_path / "one" / "benign" / "a.json").write_text("{}")
    (tmp_path / "one" / "benign" / "._b.json").write_text("{}")
    (tmp_path / "one" / "malicious" / "c.json").write_text("{}")
    (tmp_path / "one" / "malicious" / "labels.txt").write_text(" x \n\n y\n")
    found = {(r.scene, r.category, r.file, r.role) for r in edges.discover_scenes(spark, str(tmp_path)).collect()}
    assert found == {("one", "benign", "a", "log"), ("one", "malicious", "c", "log"), ("one", "malicious", "labels", "labels")}
    labels = edges.read_labels(spark, str(tmp_path / "one" / "malicious" / "labels.txt"))
    assert sorted(r.label_id for r in labels.collect()) == ["x", "y"]


def test_optc_braces_inside_strings(spark, tmp_path):
    rec = lambda i, cmd: '{"objectID":"%s","object":"PROCESS","properties":{"command_line":%s}}' % (i, cmd)
    odd = ['"awk \'{a}{b}\'"', '"x } , { y"', r'"quote \" }{ \" end"', r'"back\\"', '"{"', '"}"', '""', "null"]
    text = "\n".join(rec(f"l{i}", c) for i, c in enumerate(odd)) + "\n"
    text += "[" + ", ".join(rec(f"a{i}", c) for i, c in enumerate(odd)) + "]\n"
    text += "".join(rec(f"g{i}", c) for i, c in enumerate(odd)) + "\n"
    text += ",".join(rec(f"c{i}", c) for i, c in enumerate(odd)) + ",\n"
    text += "[" + rec("cut1", '"}{"') + ", " + rec("cut2", '"x"') + ', {"objectID":"lost"\nnot json\n{}\n'
    text += '{"objectID":"deep","properties":{"command_line":"z"},"more":{"a":{"b":[{"c":{}}]}}}\n'
    got = {r.objectID: r.properties and r.properties.command_line for r in optc.read_records(spark, write(tmp_path, "b.json", text)).collect()}
    import json

    want = {f"{k}{i}": json.loads(c) for k in "lagc" for i, c in enumerate(odd)} | {"cut1": "}{", "cut2": "x", "deep": "z"}
    assert got == want


def test_optc_edge_header(spark, tmp_path):
    text = "Source_ID Source_Type Destination_ID Destination_Type Edge_Type Timestamp\na P b F OPEN 2024-01-01T00:00:01\nc P d F READ bad\n"
    rows = edges.read_optc_edges(spark, write(tmp_path, "o.txt", text)).collect()
    assert {(r.actor_id, r.object_id, r.ts_us) for r in rows} == {("a", "b", 1704067201000000), ("c", "d", None)}


def test_technique_sources(spark, tmp_path):
    bundle = {
        "objects": [
            {"type": "attack-pattern", "id": "x1", "name": "n", "external_references": [{"source_name": "mitre-attack", "external_id": "T1", "url": "u"}]},
            {"type": "attack-pattern", "id": "x2", "name": "m", "x_mitre_is_subtechnique": True,
             "external_references": [{"source_name": "mitre-attack", "external_id": "T1.001", "url": "u"}]},
            {"type": "attack-pattern", "id": "x3", "revoked": True, "external_references": [{"source_name": "mitre-attack", "external_id": "T9"}]},
            {"type": "relationship", "relationship_type": "subtechnique-of", "source_ref": "x2", "target_ref": "x1"},
        ]
    }
    objects = techniques.read_stix_objects(spark, write(tmp_path, "s.json", json.dumps(bundle, indent=1)))
    techs = techniques.techniques(objects)
    assert sorted(r.tech_id for r in techs.collect()) == ["T1", "T1.001"]
    assert [(r.sub_id, r.parent_id) for r in techniques.parents(objects, techs).collect()] == [("T1.001", "T1")]
    triples = {"T1": [{"subject": "a", "verb": "b", "object": "c"}, {"subject": "d", "verb": "e", "object": "f"}], "T2": []}
    rows = techniques.read_triples(spark, write(tmp_path, "t.json", json.dumps(triples, indent=1)))
    assert [(r.tech_id, r.text) for r in rows.select("tech_id", techniques.triples_text(F.col("triples")).alias("text")).collect()] == [
        ("T1", "a b c. d e f")
    ]
    seqs = techniques.read_sequences(spark, write(tmp_path, "q.txt", "# c\nT1547/004,t1078\n\n T1 \t T2\n"))
    assert sorted(tuple(r.steps) for r in seqs.collect()) == [("T1", "T2"), ("T1547.004", "T1078")]
    csv = 'filepath,Body\nhttps://x/techniques/T1001/001,"line one\nline ""two"""\nhttps://x/techniques/T1002,\n'
    docs = techniques.read_documents(spark, write(tmp_path, "d.csv", csv)).collect()
    assert [(r.tech_id, r.body) for r in docs] == [("T1001.001", 'line one\nline "two"')]
