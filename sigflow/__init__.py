"""sigflow: Spark-native analytics over perturbation signatures and their
labels -- k-NN label purity, intra- vs inter-label correlations, enrichment,
compound similarity and clustering, response prediction.

Layout: ``sources`` (readers, proxy views, file formats), ``functions``
(column expressions), ``operators`` (DataFrame -> DataFrame steps),
``plans`` (registered queries and their SQL oracles).
"""
