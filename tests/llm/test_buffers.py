"""What a worker holds between its tasks."""

from lodestream.llm.buffers import giving_back, keep


def test_a_worker_keeps_what_its_tasks_ask_for_and_no_more():
    made = []

    def asking(batches):
        yield keep("a", lambda: made.append(1) or len(made))

    def other(batches):
        yield from batches

    assert [list(giving_back(asking)(iter([]))) for _ in range(2)] == [[1], [1]]
    assert list(giving_back(other)(iter([5]))) == [5]
    assert list(giving_back(asking)(iter([]))) == [2]
