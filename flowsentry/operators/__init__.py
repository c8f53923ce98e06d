"""DataFrame operators: sampling, preprocessing, quantiles, fold metrics, reports, detectors."""
