"""Settings: what the table of keys says is what is taken and refused."""

import math

import pytest

from fastaxis import config
from fastaxis.config import KEYS, ConfigError, Group, build, keys, load
from fastaxis.operators.store import snapshot

SAMPLES = [None, True, 7, 2.5, math.nan, math.inf, "word", [], ["word"], [[1.0, 2.0]], [3], {"a": 1}]


def nested(path, value):
    for name in reversed(path.split(".")):
        value = {name: value}
    return value


def value_at(settings, path):
    for name in path.split("."):
        settings = getattr(settings, name)
    return settings


def sections(node=KEYS, where=""):
    for name, entry in (node.keys if isinstance(node, Group) else node).items():
        if not isinstance(entry, config.Key):
            path = f"{where}.{name}" if where else name
            yield path, entry
            yield from sections(entry, path)


@pytest.mark.parametrize(("path", "key"), list(keys()), ids=[p for p, _ in keys()])
def test_a_key_takes_its_kind_only(path, key):
    assert value_at(build(), path) == key.default
    assert value_at(build(nested(path, key.default)), path) == key.default
    refused = [x for x in SAMPLES if not key.kind(x)]
    assert refused
    for x in refused:
        with pytest.raises(ConfigError, match=path):
            build(nested(path, x))


@pytest.mark.parametrize(("path", "bound"), [(p, b) for p, k in keys() for b in k.bounds], ids=[f"{p} {b.says}" for p, k in keys() for b in k.bounds])
def test_a_bound_is_kept(path, bound):
    key = dict(keys())[path]
    assert bound.holds(key.default) and key.kind(bound.broken) and not bound.holds(bound.broken)
    with pytest.raises(ConfigError, match=f"{path} must be"):
        build(nested(path, bound.broken))


@pytest.mark.parametrize(("path", "group"), [(p, g) for p, g in sections() if isinstance(g, Group)], ids=lambda x: x if isinstance(x, str) else "")
def test_settings_that_depend_on_each_other(path, group):
    for names, holds, says in group.together:
        defaults = [group.keys[n].default for n in names]
        assert holds(*defaults)
        turned = dict(zip(names, reversed(defaults), strict=True))
        changed = turned if not holds(*turned.values()) else {names[0]: defaults[0] + 1}
        with pytest.raises(ConfigError, match=says):
            build(nested(path, changed))


@pytest.mark.parametrize("where", ["", *[p for p, _ in sections()]])
def test_a_section_is_a_mapping_of_known_keys(where):
    for wrong in ([1], "word", 3, None):
        if where or wrong is not None:
            with pytest.raises(ConfigError, match="no mapping"):
                build(nested(where, wrong) if where else wrong)
    with pytest.raises(ConfigError, match="unknown"):
        build(nested(f"{where}.zzz" if where else "zzz", 1))


def test_files(tmp_path):
    (tmp_path / "empty.yaml").write_text("")
    assert load(tmp_path / "empty.yaml").to_dict() == build().to_dict()
    (tmp_path / "some.yaml").write_text("sws:\n  windows:\n    nend: 4\n    tend1: 2\nlogging:\n  level: info\n")
    some = load(tmp_path / "some.yaml")
    assert (some.sws.windows.nend, some.sws.windows.tend1, some.sws.windows.nbeg, some.logging.level) == (4, 2, 10, "info")
    (tmp_path / "broken.yaml").write_text("sws: [1, 2")
    for name in ("broken.yaml", "nowhere.yaml"):
        with pytest.raises(ConfigError, match=name):
            load(tmp_path / name)


def test_settings_cannot_be_changed():
    made = build()
    with pytest.raises(AttributeError):
        made.sws.cluster.n_min = 4
    made.sws.blacklist_stations.append("x")
    assert build().sws.blacklist_stations == []


def test_snapshot_leaves_connections_out():
    text = snapshot(build({"seiscomp": {"database": "mysql://reader:hidden@db/main"}, "logging": {"file": "/var/log/x"}}))
    assert not any(x in text for x in ("hidden", "archive", "/var/log")) and all(x in text for x in ("omega1", "min_gap", "n_cores"))
