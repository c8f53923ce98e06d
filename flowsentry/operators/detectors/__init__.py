"""Learned and expression detectors (one-class RFF SVM, isolation forest, autoencoder, PCA)."""
