"""Nested records: a chosen mapping reads as many turns as the record has."""

import pytest

from raregrain.llm import chat

TURNS = [("user", "hi"), ("assistant", "yes")]
NESTED = {
    "nested_messages": {"data": {"messages": [{"role": r, "content": t} for r, t in TURNS]}},
    "message_parts": {"messages": [{"role": r, "content": [{"type": "text", "text": t[:1]}, {"type": "text", "text": t[1:]}]} for r, t in TURNS]},
    "message_tree": {"mapping": {"messages": [{"author": {"role": r}, "content": {"parts": [t[:1], t[1:]]}} for r, t in TURNS]}},
    "messages": {"messages": [{"role": r, "content": t} for r, t in TURNS]},
}


@pytest.mark.parametrize("name", NESTED)
def test_nested_turns(name):
    mapping = chat.choose(chat.field_paths(NESTED[name]))
    assert mapping.name == name and chat.canonical(NESTED[name], mapping) == TURNS


def test_paths_of_own_mappings():
    own = chat.Mapping("x", turns="data.messages", role="author.role", text="content")
    record = {"data": {"messages": [{"author": {"role": "user"}, "content": "hi"}, {"author": {"role": "assistant"}, "content": None}]}}
    assert chat.choose(chat.field_paths(record), [own]) and chat.canonical(record, own) == [("user", "hi"), ("assistant", "")]
    single = chat.Mapping("y", single=(("q.text", "user"), ("a[].text", "assistant")), required=("q.text", "a[].text"))
    record = {"q": {"text": "hi"}, "a": [{"text": "yes"}, {"text": "no"}]}
    assert chat.canonical(record, single) == [("user", "hi"), ("assistant", "yes"), ("assistant", "no")]
    dotted = {"q.text": "hi", "a": [{"text": "yes"}]}
    assert chat.canonical(dotted, single) == TURNS


def test_mixed_contents_keep_every_turn():
    record = {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"text": "yes"}]}]}
    assert len(chat.canonical(record, chat.choose(chat.field_paths(record)))) == 2
    parts = chat.Mapping("p", turns="messages", role="role", text="content[].text")
    assert chat.canonical(record, parts) == TURNS
