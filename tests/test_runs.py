from millrace.plans import runs


def test_all_faults_come_together():
    bad = {"tasks": [{"id": "a", "dependsOn": ["b", "x"]}, {"id": "b", "dependsOn": ["a"]}, {"id": "b", "dependsOn": ["b"]}]}
    assert runs.errors(bad) == ["duplicate task id 'b'", "task 'a' depends on unknown task 'x'", "task 'b' depends on itself", "cycle detected (depends on): a -> b -> a"]
    assert runs.errors({"tasks": [{"id": f"t{n}", "dependsOn": [f"t{n - 1}"] if n else []} for n in range(10_000)]}) == []


def test_ids_repeat_by_owner_and_key():
    assert runs.run_id("me", "k") == runs.run_id("me", "k") != runs.run_id("you", "k")
    assert runs.run_id("me") != runs.run_id("me") and runs.run_id("me", "k")[14] == "3"
