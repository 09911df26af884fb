"""Every operator bound to the test tables, each with independent SQL where SQL can say it."""

from workload import catalogue, fields, learning, models, reports, samples, scans, words

MODULES = (scans, fields, catalogue, samples, words, reports, learning, models)
