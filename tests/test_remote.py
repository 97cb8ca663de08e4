"""Remote scorers against a local server, and labels against a public tokenizer."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from decidra.functions import arrays as A
from decidra.functions.text import Alphabet, label_alphabet
from decidra.operators import scoring
from decidra.sources import remote

SF = "/root/testdata/sf0.001"


class Server(BaseHTTPRequestHandler):
    """Log-probabilities by the prompt's length; every fifth prompt fails once, and prompts with a word lack things."""

    seen, at_once, most, lock = Counter(), 0, 0, threading.Lock()

    def do_POST(self):
        with self.lock:
            Server.at_once += 1
            Server.most = max(Server.most, Server.at_once)
        try:
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = asked["prompt"]
            Server.seen[prompt] += 1
            if "refuse" in prompt:
                return self.send_error(400)
            if len(prompt) % 5 == 0 and Server.seen[prompt] == 1:
                return self.send_error(503)
            rows = [[-float(len(prompt) % (7 + i)), label, str(label)] for i, label in enumerate(asked["labels"]) if "lack" not in prompt or i]
            states = [] if "empty" in prompt else [[[0.0] * 4, [float(len(prompt)), 1.0, 2.0, 3.0]]]
            said = json.dumps({"meta_info": {"output_token_ids_logprobs": [rows], "hidden_states": states}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(said)
        finally:
            with self.lock:
                Server.at_once -= 1

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/generate"
    server.shutdown()


def ask(spark, url, prompts, **more):
    df = spark.createDataFrame([(i, p, [11, 22, 33]) for i, p in enumerate(prompts)], "id long, prompt string, labels array<int>").coalesce(2)
    return remote.score_remote(df, lambda: remote.http_post(url), remote.generate_id_logprobs, 2.0, lambda b: remote.last_hidden(b, 4), in_flight=4, pause=0.01, **more)


def test_documents_are_scored_by_a_server(spark, url):
    texts = [(r.text or "")[:80] + str(r.doc_id) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = [t for t in texts if not any(w in t for w in ("lack", "refuse", "empty"))]
    out = ask(spark, url, texts)
    scored = {r.id: r for r in out.withColumn("evidence", scoring.evidence_head(F.col("hidden"), [0.5, 0.1, -0.1, 0.2], 0.3)).collect()}
    assert len(scored) == len(texts)
    for i, t in enumerate(texts):
        want = remote.option_probabilities({k: -float(len(t) % (7 + j)) for j, k in enumerate((11, 22, 33))}, [11, 22, 33], 2.0)
        assert scored[i].probs == pytest.approx(want) and scored[i].hidden == [float(len(t)), 1.0, 2.0, 3.0] and 0 < scored[i].evidence < 1
    assert all(Server.seen[t] == (2 if len(t) % 5 == 0 else 1) for t in texts if texts.count(t) == 1)  # tried again only where it failed
    assert Server.most <= 8  # two partitions of four


@pytest.mark.parametrize(("prompt", "why"), [("lack of labels", "no log-probability for .11"), ("an empty state", "a hidden state of 0 numbers"), ("refuse it", "400")])
def test_what_a_server_lacks_is_an_error(spark, url, prompt, why):
    with pytest.raises(Exception, match=why):
        ask(spark, url, [prompt]).collect()
    assert Server.seen["refuse it"] <= 1 or prompt != "refuse it" or Server.seen[prompt] < 5


def test_answers_in_all_shapes():
    triple = {"meta_info": {"output_top_logprobs": [[(-1.0, 5, "A"), (None, 6, "B"), [1.0]]]}}
    assert remote.generate_id_logprobs(triple) == {5: -1.0} == remote.generate_id_logprobs([{}, triple])
    assert remote.generate_id_logprobs({"meta_info": {"output_token_ids_logprobs": [[{"token_id": 3, "logprob": -2}, {"token_id": None, "logprob": 1}]]}}) == {3: -2.0}
    assert remote.generate_id_logprobs({}) == {} and remote.last_hidden({"hidden_states": [[[1, 2], [3, 4]]]}) == [3.0, 4.0] and remote.last_hidden({"hidden_states": [5, 6]}, 2) == [5.0, 6.0]
    for body, width in (({}, None), ({"hidden_states": [[]]}, None), ({"hidden_states": [1.0]}, 2)):
        with pytest.raises(remote.BadHidden):
            remote.last_hidden(body, width)


def test_labels_of_one_token(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    found = Alphabet.of(encode, 255)
    single = [w for w in label_alphabet(702) if len(encode(" " + w)) == 1]
    assert list(found.labels) == single[:255] and [encode(" " + w) for w in found.labels] == [[i] for i in found.ids] and encode(" yes") == [found.yes]
    with pytest.raises(ValueError, match="labels of one token"):
        Alphabet.of(encode, len(single) + 1)
    with pytest.raises(ValueError, match="no"):
        Alphabet.of(lambda t: [1, 2] if t == " no" else [7])
    with pytest.raises(ValueError):
        label_alphabet(703)
    logits = [0.0] * tokenizer.get_vocab_size()
    logits[found.ids[1]], logits[found.no] = 2.0, 1.0
    df = spark.createDataFrame([("choice", 3, logits), ("bool", 2, logits)], "qtype string, n int, z array<double>")
    rows = df.select("qtype", A.label_readout(F.col("z"), found.option_ids(F.col("qtype"), F.col("n"))).alias("p")).collect()
    assert [len(r.p) for r in rows] == [3, 2] and rows[0].p[1] == max(rows[0].p) and rows[1].p[1] == pytest.approx(0.7310585786)
