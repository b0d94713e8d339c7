"""kvern.operators"""
