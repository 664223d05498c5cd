"""Schemas of the engine's tables as DDL; sources are read with them, never by inference."""

CATALOG = ("id string, title string, author string, language string, category string, subjectsCsv string, summary string, coverUrl string, "
    "contentPath string, wordCount int, isFeatured boolean, source string, sourceId string, gutenbergId bigint"
)
PROGRESS = ("bookId string, progressPercent double, lastLocation string, updatedAt timestamp")
CLIENT_PROGRESS = ("userId bigint, bookId string, percent double, updatedAt bigint, receivedAt timestamp_ntz")
CATEGORY = ("ord int, id string, label string, blurb string, accent string, emoji string")
IMPORT_SPEC = ("id string, title string, author string, category string, language string, gutenbergId bigint, isFeatured boolean")
SEARCH_PAGE = ("results array<struct<id bigint, title string, authors array<struct<name string>>, languages array<string>, subjects array<string>>>, next string"
)
WANTED = ("title string, author string, shelf string, cat string, core100 boolean")
HIGHLIGHTS = "array<struct<atomIndex:int,start:int,`end`:int,color:string>>"
