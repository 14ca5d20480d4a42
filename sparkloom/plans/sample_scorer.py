"""A user's module as ``operators.extend`` ships it: the catalogue scores rows with it."""


def score(data_source, solution_str, ground_truth, bonus=0.0):
    """Share of the gold words that the answer has, and a bonus for one source."""
    words = set(ground_truth.split())
    hit = len(words & set(solution_str.split())) / len(words) if words else 0.0
    return {"score": hit + (bonus if data_source == "even" else 0.0)}
