"""Limits of the collecting site and the settings of each genre."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Result pages show PAGE_RESULTS in all at most WINDOW_PAGES pages from either end.
ALL_PAGES_LIMIT, TWO_WINDOWS_LIMIT, WINDOW_PAGES, STEM_LIMIT, UID_LIMIT = 100, 200, 10, 180, 48
SITE = "https://poems.example"
HOSTS = ("poems.example", "www.poems.example")
SPLITS, RATIOS, SEED = ("train", "test", "val"), (0.8, 0.1, 0.1), 42
#: Seconds: delay and jitter of requests; every PAUSE_EVERY requests a long pause.
DELAY, JITTER, PAUSE_EVERY, PAUSE = 5.0, 3.0, 40, (300.0, 600.0)
#: How a page that asks for proof of a human says so, its captcha, and the marks of
#: ordinary pages.
CHALLENGE, CAPTCHA = "Xác nhận không phải máy truy cập tự động", 'class="g-recaptcha"'
ORDINARY_MARKS = ('class="poem-content', "list-item-header", 'name="PoemType"', "search-author.php")
#: Answers that are worth another try.
RETRIED = (429, 500, 502, 503, 504)
PROGRESS_SCHEMA, REPORT_SCHEMA = "poem-progress-v1", "poem-report-v1"
CHECKPOINT_SCHEMAS = ("url-partitions-v2", "url-partitions-v3", "url-partitions-v4")
#: The periods that each country with more results than a window is divided into.
LEAF_AGES = {
    "2": ["50", "52", "53", "54", "55", "56", "57", "2", "3"],
    "3": ["21", "22", "23", "24", "25", "26", "27", "5", "6", "7", "8", "9", "10", "12", "13", "28", "29", "14", "15", "16", "17", "18"],
}


@dataclass(frozen=True)
class Genre:
    """What one genre's collection differs in."""

    name: str
    poem_type: int | None
    countries: tuple[str, ...] | None = None
    mode: str = "country-age"
    ages: dict[str, dict[str, int]] = field(default_factory=dict)

    @property
    def search_url(self) -> str:
        return f"{SITE}/search-poem.php?PoemType={self.poem_type}&ViewType=2"


#: Types, countries and expected counts by country and period.
GENRES = {
    g.name: g
    for g in (
        Genre("phu", 2),
        Genre("cau-doi", 28),
        Genre("duong-luat-bien-the", 23, ("2", "3")),
        Genre("tu-ngon", 10),
        Genre("ngu-ngon-tu-tuyet", 3),
        Genre("that-ngon-co-phong", 8, ("3", "2"), "country-age", {"3": {"5": 5, "6": 8, "7": 11, "8": 183, "9": 77, "10": 15, "12": 0, "13": 71, "14": 37, "15": 87, "16": 43, "17": 1, "18": 1}}),
        Genre("that-ngon-bat-cu", 7, ("2",), "shallow", {"2": {"52": 3, "53": 347, "54": 54, "55": 1426, "56": 266, "57": 1695, "2": 784}}),
        Genre("kinh-thi", None, None, "group-tree"),
    )
}
