"""Adapters that stand for a decoder, a detector and an OCR program."""


def frames(raw):
    return [(2000, 2400, b"png %d" % i) for i in range(int(raw))]


def detector(image_size=None):
    def detect(path):
        # Four blocks below each other on each page, of another height on each.
        page = int(path.rsplit("_", 1)[1].split(".")[0])
        return [(9, "Text", 0.9, 100.0, 100.0 + 200 * i, 500.0, 180.0 + 200 * i + page) for i in range(4)] + [(9, "Text", 0.1, 0.0, 0.0, 9.0, 9.0)]

    return detect


def reader():
    def read(path, box):
        return f"{path.rsplit('/', 1)[1]} at {box[1]}", ""

    return read
